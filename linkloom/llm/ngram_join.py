"""N-gram Jaccard join with Bayesian candidate pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, blocks, components, Forest, mark, runs, save, small, small_batches, sweep, tidy

PERMS, BANDS = 128, 32
#: Hashes after which a pair is judged again.
CHECKS = (16, 32, 64, 96, 128)
_rng = np.random.default_rng(11)
_MUL = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles of the whole text.
    Words stand between ASCII white space, A-Z lowered; a text of fewer words
    is one shingle, a text without words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    seen: dict[bytes, int] = {}
    get, digest = seen.get, xxhash.xxh3_64_intdigest
    h = np.fromiter([get(w) or seen.setdefault(w, digest(w)) for w in words], np.uint64, len(words))
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : m + k]) * _MIX[0] + np.uint64(k)
            out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def minhash(s: np.ndarray) -> np.ndarray:
    low = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            low = np.minimum(low, (s[i : i + 2048, None] * _MUL + _ADD).min(axis=0))
    return low


@lru_cache(8)
def needed(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each of CHECKS the fewest equal hashes with which the posterior
    probability (uniform prior) of a similarity of threshold or more is still
    tolerance: P(Binomial(n + 1, threshold) <= equal)."""
    out = []
    for n in CHECKS:
        total, k = 0.0, -1
        while total < tolerance:
            k += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(k + 1) - math.lgamma(n + 2 - k) + k * math.log(threshold) + (n + 1 - k) * math.log1p(-threshold))
        out.append(k)
    return tuple(out)


def survivors(one: np.ndarray, many: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Rows of many that the incremental comparison with one doesn't drop."""
    left, done, equal = np.arange(len(many)), 0, np.zeros(len(many), np.int64)
    for n, k in zip(CHECKS, least, strict=True):
        equal = equal + (many[left, done:n] == one[done:n]).sum(axis=1)
        ok = equal >= k
        left, equal, done = left[ok], equal[ok], n
    return left


def link_bucket(sigs: np.ndarray, side: np.ndarray, least: tuple[int, ...]) -> list[tuple[int, int]]:
    """Edges that connect what the surviving pairs of a bucket connect. Two
    members are compared only while nothing else has connected them, so a
    group of near copies costs about one comparison a member. With two blocks,
    pairs across them count."""
    n, forest = len(sigs), Forest(len(sigs))
    if n == 2:
        return [(0, 1)] if len(survivors(sigs[0], sigs[1:], least)) else []
    two = side.any() and not side.all()
    root = np.arange(n)
    for i in range(n):
        other = np.flatnonzero(root != root[i]) if two else i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        if two:
            other = other[(other > i) & (side[other] != side[i])]
        if not len(other):
            continue
        hit = other[survivors(sigs[i], sigs[other], least)]
        if len(hit):
            for j in hit.tolist():
                forest.union(i, j)
            joined = np.isin(root, np.append(root[hit], root[i]))
            root[joined] = root[joined].min()
    return forest.made


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, sets, sigs, bands = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, n)
                count.append(len(s))
                if not len(s):
                    sets.append(None)
                    sigs.append(None)
                    bands.append(None)
                    continue
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                low = minhash(s)
                # one byte a hash: unequal values agree by chance once in 256, which drops nothing
                sigs.append((low >> np.uint64(40)).astype(np.uint8).tobytes())
                rows = low.reshape(BANDS, -1)
                key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[2]
                with np.errstate(over="ignore"):
                    for c in range(rows.shape[1]):
                        key = (key ^ rows[:, c]) * _MIX[0]
                        key ^= key >> np.uint64(31)
                bands.append(key.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["uid", "n", "set", "sig", "bands"],
            )

    return run


def _link(least: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[int] = []
        vs: list[int] = []
        for group in runs(batches, 3):
            ids = group["cid"].to_numpy()
            if len(ids) > 1:
                sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(ids), PERMS)
                side = group["mine"].to_numpy() != group["bi"].to_numpy()
                for a, b in link_bucket(sigs, side, least):
                    us.append(int(ids[a]))
                    vs.append(int(ids[b]))
            if len(us) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def shared(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[rows] and sets[cols]."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = n[at] > 1  # what one set holds alone is shared by no pair
    owner, at = owner[use], (np.cumsum(n > 1) - 1)[at[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    width, step = int((n > 1).sum()), 1024
    for c in range(0, width, step):
        a, b = np.searchsorted(at, [c, c + step])
        x = np.zeros((len(sets), min(step, width - c)), np.float32)
        x[owner[a:b], at[a:b] - c] = 1
        out += x[rows] @ x[cols].T
    return out


def _verify(n: int, threshold: float, least: tuple[int, ...], few: float = 0.02):
    """Of the pairs of two blocks, those that the incremental comparison
    doesn't drop are verified exactly: one by one while they are few, by
    counting all shared shingles of the blocks where many survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            ids, mult = group["cid"].to_numpy(), group["mult"].to_numpy()
            if len(ids) < 2:
                continue
            sets = [shingles(t, n) for t in group["t"].to_pylist()]
            size = np.array([len(s) for s in sets])
            sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(ids), PERMS)
            mine, bi, bj = group["mine"].to_numpy(), group["bi"][0].as_py(), group["bj"][0].as_py()
            rows, cols = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
            begin = [k + 1 if bi == bj else 0 for k in range(len(rows))]  # each pair once
            left = [k + survivors(sigs[i], sigs[cols[k:]], least) for i, k in zip(rows.tolist(), begin, strict=True)]
            many = sum(map(len, left)) > few * len(rows) * len(cols) and len(sets) > 4
            both = shared(sets, rows, cols) if many else None
            links, forest, root = np.zeros(len(ids), np.int64), Forest(len(ids)), np.arange(len(ids))
            for k, (i, at) in enumerate(zip(rows.tolist(), left, strict=True)):
                if not len(at):
                    continue
                other = cols[at]
                common = both[k, at].astype(np.int64) if many else np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in other.tolist()])
                # |A & B| / |A | B| >= threshold, to the integer where threshold is a decimal
                other = other[common * 10_000 >= round(threshold * 10_000) * (size[i] + size[other] - common)]
                links[i] += mult[other].sum()
                links[other] += mult[i]
                near = root[other]
                if len(near) and (near != root[i]).any():
                    for r in np.unique(near).tolist():
                        forest.union(i, r)
                    joined = np.isin(root, np.append(near, root[i]))
                    root[joined] = root[joined].min()
            u = [*ids.tolist(), *(int(ids[a]) for a, _ in forest.made)]
            v = [*[None] * len(ids), *(int(ids[b]) for _, b in forest.made)]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([*links.tolist(), *[0] * len(forest.made)], pa.int64())], ["u", "v", "links"])

    return run


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    n: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-7,
    block: int = 1024,
    bucket: int = 32768,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """docs with class_id, n_links and kept.

    Two documents are linked if the Jaccard similarity of their sets of n-word
    shingles is at least threshold. n_links counts the other documents linked
    directly, copies included; class_id is the smallest doc_id that links
    reach (itself included); kept marks one document of each class, the one
    with the smallest doc_id (null last).

    Documents with one set collapse first, so a group of copies of any size is
    one member. MinHash bands put members in buckets; in a bucket the MinHash
    values of two members are compared in steps, and a pair is dropped once
    the posterior probability of reaching threshold is under tolerance.
    Members that survivors connect form groups, in which every pair is
    compared so again, and every pair that isn't dropped verified exactly on
    its shingles. Buckets and groups above a block are
    split in blocks of which every two meet, in tasks of bounded size; tasks
    return counts and the edges of a forest, never all pairs. Only pairs whose
    similarity is at threshold and that share none of 32 bands of 4 values
    (one in 10^7) or that the pruning drops (one in 10^6) can be missed.

    Null or empty text and text without words links with nothing. Fewer than n
    words are one shingle. Repeated rows are copies. Columns named class_id,
    n_links or kept are replaced.
    """
    small_batches(docs.sparkSession)
    since = mark()
    least = needed(threshold, tolerance)
    docs = docs.drop("class_id", "n_links", "kept")
    rows = save(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "docs")
    body = F.col(f"row.`{text}`").cast("binary")
    feats = save(rows.select("uid", body.alias("t")).mapInArrow(tidy(_features(n)), "uid long, n long, set binary, sig binary, bands array<long>"), "features")
    classes = feats.where("n > 0").groupBy("set").agg(F.min("uid").alias("cid"), F.count(F.lit(1)).alias("mult"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = save(classes, "classes")
    keys = classes.select(F.explode("bands").alias("key"), "cid")
    full = save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    inside = keys.join(small(full, 32), "key").select("key", "cid", blocks(F.col("members"), bucket).alias("nb"))
    inside = inside.join(small(classes.select("cid", "sig"), 200), "cid")
    met = block_pairs(inside, "key", "nb", "cid").select("key", "bi", "bj", "mine", "cid", "sig")
    met = met.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "cid")
    edges = met.mapInArrow(tidy(_link(least)), "u long, v long")
    groups = components(edges)

    sized = save(
        groups.select(F.col("node").alias("cid"), F.col("label").alias("grp"))
        .join(classes.select("cid", "mult", "sig"), "cid")
        .join(feats.select(F.col("uid").alias("cid"), "n"), "cid"),
        "sized",
    )
    per = sized.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    per = per.select("grp", F.greatest(blocks(F.col("members"), block), blocks(F.col("shingles") * 16, block_bytes)).alias("nb"))
    sized = save(sized.join(per, "grp").select(F.col("cid").alias("uid"), "grp", "mult", "sig", "nb"), "members")
    texts = rows.select("uid", body.alias("t")).join(small(sized, 200), "uid").withColumnRenamed("uid", "cid")
    met = block_pairs(texts, "grp", "nb", "cid").select("grp", "bi", "bj", "mine", "cid", "mult", "sig", "t")
    met = met.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "cid")
    found = save(met.mapInArrow(tidy(_verify(n, threshold, least)), "u long, v long, links long"), "links")
    links = found.where("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    labels = components(found.where("v IS NOT NULL").select("u", "v"))

    known = classes.select("set", "cid", "mult").join(links, "cid", "left").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
    known = known.select("set", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("label", "cid").alias("label"))
    known = save(known.where("n_links > 0"), "known")
    linked = feats.select("uid", "set").where("set IS NOT NULL").join(small(known, 96), "set").select("uid", "n_links", "label")
    linked = save(linked.join(rows.select("uid", F.col(f"row.`{doc_id}`").alias("id")), "uid"), "linked")
    first = save(linked.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("f")), "first")
    final = save(linked.join(small(first, 96), "label").select("uid", "n_links", F.col("f.id").alias("class_id"), (F.col("uid") == F.col("f.uid")).alias("first")), "final")
    sweep(docs.sparkSession, since, rows, final)
    out = rows.join(small(final, 48), "uid", "left")
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.when(F.col("n_links").isNull(), F.col(f"row.`{doc_id}`")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("first", F.lit(True)).alias("kept"),
    )
