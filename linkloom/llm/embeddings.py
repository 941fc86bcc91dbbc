"""Near-duplicate vectors by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_pairs, blocks, components, Forest, mark, runs, save, small, small_batches, sweep, tidy

#: Rows compared at once when neighbour lists are begun.
SLICE = 256


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is scaled by its largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _codes(tables: int, seed: int):
    """(table, code, cid, v): the signs of 20 random projections, a new set for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            for t in range(tables):
                plane = np.random.default_rng(seed + t).standard_normal((x.shape[1], 20))
                code = ((x @ plane) > 0) @ (1 << np.arange(20))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([seed + t] * n, pa.int64()), pa.array(code, pa.int64()), batch.column(0), batch.column(1)], ["table", "code", "cid", "v"])

    return run


def _top(ids: np.ndarray, sims: np.ndarray, bar: np.ndarray | None, k: int) -> tuple[list, list, list]:
    """For each row of sims its k best columns, if they beat the row's bar."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(sims, best, 1)
    use = s > (np.full(len(ids), -2.0) if bar is None else bar)[:, None]
    return np.repeat(ids, k).reshape(-1, k)[use], ids[best][use], s[use]


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["u", "v", "s"])


def _begin(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = _matrix(batch.column(1))
            for i in range(0, len(ids), SLICE // 2):  # overlapping slices of rows that sort alike
                a = slice(i, i + SLICE)
                if len(ids[a]) > 1:
                    yield _edges(*_top(ids[a], x[a] @ x[a].T, None, k))

    return run


def _join(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 1):
            ids = group["cid"].to_numpy()
            if len(ids) > 1:
                x = _matrix(group["v"])
                u, v, s = _top(ids, x @ x.T, group["bar"].to_numpy(), k)
                if len(u):
                    yield _edges(u, v, s)

    return run


def _verify(threshold: float):
    """For the pairs of two blocks: by vector the number of links, weighted,
    and the edges of a forest that connects what links connect. Cosines of
    SLICE rows at a time are held, and none of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            ids, mult, mine = group["cid"].to_numpy(), group["mult"].to_numpy(), group["mine"].to_numpy()
            bi, bj = group["bi"][0].as_py(), group["bj"][0].as_py()
            x = _matrix(group["v"])
            rows, cols = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
            links, forest, root = np.zeros(len(ids), np.int64), Forest(len(ids)), np.arange(len(ids))
            y, weight = x[cols].T, mult[cols]
            for at in range(0, len(rows), SLICE):
                part = rows[at : at + SLICE]
                ok = x[part] @ y >= threshold
                if bi == bj:
                    ok[np.arange(len(part)), np.arange(at, at + len(part))] = False
                links[part] += ok @ weight
                if bi != bj:
                    links[cols] += mult[part] @ ok
                for i, hit in zip(part.tolist(), ok, strict=True):
                    near = root[cols[hit]]
                    if len(near) and (near != root[i]).any():
                        for r in np.unique(near).tolist():
                            forest.union(i, r)
                        joined = np.isin(root, np.append(near, root[i]))
                        root[joined] = root[joined].min()
            u = [*ids.tolist(), *(int(ids[a]) for a, _ in forest.made)]
            v = [*[None] * len(ids), *(int(ids[b]) for _, b in forest.made)]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([*links.tolist(), *[0] * len(forest.made)], pa.int64())], ["u", "v", "links"])

    return run


def _compare(members: DataFrame, threshold: float) -> DataFrame:
    """What _verify finds in all pairs of the same grp, in nb blocks."""
    met = block_pairs(members, "grp", "nb", "cid").select("grp", "bi", "bj", "mine", "cid", "mult", "v")
    return met.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "cid").mapInArrow(tidy(_verify(threshold)), "u long, v long, links long")


def _exact_edges(vecs: DataFrame, threshold: float, block: int) -> DataFrame:
    """Edges that join all linked vecs into their groups, from all pairs."""
    whole = vecs.select("cid", F.lit(0).cast("long").alias("grp"), blocks(F.lit(vecs.count()), block).alias("nb"), "mult", "v")
    return save(_compare(whole, threshold).where("v IS NOT NULL").select("u", "v"), "exact")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar neighbours of each u."""
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _descend(graph: DataFrame, vecs: DataFrame, k: int, rounds: int) -> DataFrame:
    for _ in range(rounds):
        bar = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(-2.0).alias("bar"))
        back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")
        near = graph.union(_best(back, k)).select(F.col("u").alias("at"), F.col("v").alias("cid"))
        near = near.union(graph.select(F.col("u").alias("at"), F.col("u").alias("cid"))).distinct()
        rows = near.join(vecs, "cid").join(bar.withColumnRenamed("u", "cid"), "cid").select("at", "cid", "v", "bar")
        found = save(rows.repartition("at").sortWithinPartitions("at").mapInArrow(tidy(_join(k)), "u long, v long, s double"), "found")
        better = save(_best(graph.union(found), k), "graph")
        changed = better.join(graph.select("u", "v"), ["u", "v"], "left_anti").count()
        graph = better
        if changed <= 0.01 * k * max(1, vecs.count()):
            break
    return graph


def _audited(vecs: DataFrame, threshold: float, sample: int, enough: int = 32, tries: int = 3) -> DataFrame:
    """The true links of ``sample`` vectors; of four times as many, twice over,
    while under ``enough`` of them have any."""
    n = vecs.count()
    for k in range(tries):
        true = save(_true_links(vecs, threshold, sample << 2 * k), "audit")
        if (sample << 2 * k) >= n or true.select("u").distinct().count() >= enough:
            break
    return true


def _true_links(vecs: DataFrame, threshold: float, sample: int) -> DataFrame:
    """Brute force: the links of ``sample`` vectors, those with the smallest hash, against all."""
    picked = vecs.orderBy(F.xxhash64("cid"), "cid").limit(sample).collect()  # the audit's documented bound
    ids = np.array([r["cid"] for r in picked], np.int64)
    sent = vecs.sparkSession.sparkContext.broadcast((ids, _unit(np.array([r["v"] for r in picked], np.float64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                a, b = np.nonzero(_matrix(batch.column(1)) @ q.T >= threshold)
                use = own[a] != ids[b]
                yield pa.RecordBatch.from_arrays([pa.array(ids[b][use]), pa.array(own[a][use])], ["u", "v"])

    return vecs.mapInArrow(tidy(run), "u long, v long")


def _recall(true: DataFrame, groups: DataFrame, k: int) -> float:
    """The mean share, by sampled vector, of its true links that lie in its
    group; the least of that over all vectors, and over those with at most k
    links or with more."""
    a, b = groups.select(F.col("node").alias("u"), F.col("label").alias("gu")), groups.select(F.col("node").alias("v"), F.col("label").alias("gv"))
    each = true.join(a, "u", "left").join(b, "v", "left").groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gu") == F.col("gv")).alias("got"))
    share = F.col("got") / F.col("n")
    means = each.agg(F.avg(share), F.avg(F.when(F.col("n") <= k, share)), F.avg(F.when(F.col("n") > k, share))).first()
    return min((x for x in means if x is not None), default=1.0)


def near_vectors(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.95,
    k: int = 10,
    tables: int = 6,
    rounds: int = 4,
    audit: int = 256,
    wanted: float = 0.98,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """key, n_links, component_id and kept of each row.

    Equal vectors collapse first. Neighbour lists of k begin from slices of
    rows that sort alike by random projections; NN-descent refines them by
    joining the neighbours of each node, sent with the similarity they have to
    beat, until under 1 % of the lists change. Links of threshold or more make
    groups. A list whose k neighbours all are links is saturated: there may be
    more, in its group and outside. So the lists of saturated vectors are
    enlarged at once to all other saturated vectors (of a link outside its
    lists, both ends are saturated), which joins groups; then in each group
    every pair is computed in double precision. Both go in blocks of
    block_bytes of which every two meet, with no cap; the products are the
    square of the number of saturated vectors and of a group, and a vector is
    sent once for each block of its group. An audit compares ``audit`` sampled
    vectors (up to 16 times as many while few of them have links) with all
    others by brute force. Below the wanted recall, as a mean over the vectors
    and over those of few and of many links apart, the search goes on with
    lists and tables of twice the number; after three tries, all pairs are
    compared, so no result leaves with less.

    Vectors that are null, empty, zero or hold nulls or non-finite components
    link with nothing; vectors of different length don't link. component_id is
    the smallest key that links reach. Repeated keys and rows are vectors of
    their own; a null key has a null component_id unless others are linked.
    Components of any finite size are compared alike. Other columns of rows,
    clashing ones too, are not part of the result.
    """
    small_batches(rows.sparkSession)
    since = mark()
    v = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    base = save(rows.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("id"), F.when(fine, v).alias("v")), "rows")
    reps = base.where("v IS NOT NULL").groupBy("v").agg(F.min("uid").alias("cid"), F.count(F.lit(1)).alias("mult"))
    reps = save(reps.select("cid", "mult", "v", F.size("v").alias("dim")), "vectors")
    links = labels = None
    for dim in sorted(r[0] for r in reps.groupBy("dim").count().collect()):  # lengths of vectors: a handful
        vecs = reps.where(F.col("dim") == dim).select("cid", "v", "mult")
        n = vecs.count()
        block = max(SLICE, block_bytes // (8 * dim))
        true = _audited(vecs.select("cid", "v"), threshold, audit)
        graph, seed, width, planes = None, 100, k, tables
        for _ in range(3):
            coded = vecs.select("cid", "v").mapInArrow(tidy(_codes(planes, seed)), "table long, code long, cid long, v array<double>")
            parts = max(1, -(-n * planes // (32 * SLICE)))
            begun = coded.repartitionByRange(parts, "table", "code", "cid").sortWithinPartitions("table", "code", "cid").select("cid", "v").mapInArrow(tidy(_begin(width)), "u long, v long, s double")
            graph = save(_best(begun if graph is None else graph.union(begun), width), "graph")
            graph = _descend(graph, vecs.select("cid", "v"), width, rounds)
            near = graph.where(F.col("s") >= threshold - 1e-6)
            full = save(near.groupBy("u").count().where(F.col("count") >= width).select(F.col("u").alias("cid")), "full")
            more = _exact_edges(save(vecs.join(small(full, 16), "cid"), "saturated"), threshold, block)
            groups = components(near.select("u", "v").union(more))
            if _recall(true, groups, k) >= wanted:
                break
            seed, width, planes = seed + planes, 2 * width, 2 * planes
        else:  # the search misses links here: all pairs
            groups = components(_exact_edges(vecs, threshold, block))
        sizes = save(groups.groupBy("label").agg(F.count(F.lit(1)).alias("members")), "sizes")
        members = groups.select(F.col("node").alias("cid"), F.col("label").alias("grp")).join(small(sizes.withColumnRenamed("label", "grp"), 32), "grp")
        members = members.select("cid", "grp", blocks(F.col("members"), block).alias("nb")).join(vecs, "cid")
        found = save(_compare(members, threshold), "links")
        some = found.where("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
        named = components(found.where("v IS NOT NULL").select("u", "v"))
        links = some if links is None else links.union(some)
        labels = named if labels is None else labels.union(named)
    if links is None:
        return base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    known = reps.join(links, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    known = save(known.select("v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("label", "cid").alias("label")).where("n_links > 0"), "known")
    hit = save(base.where("v IS NOT NULL").join(small(known, 600), "v").select("uid", "id", "n_links", "label"), "hit")
    first = save(hit.groupBy("label").agg(F.min("id").alias("first")), "first")
    final = save(hit.join(small(first, 48), "label").select("uid", "n_links", "first"), "final")
    sweep(rows.sparkSession, since, base, final)
    out = base.select("uid", "id").join(small(final, 48), "uid", "left")
    least = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("first"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"),
        (F.col("id") == least).alias("kept"),
    )
