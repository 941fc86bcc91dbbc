"""Removal of repeated byte strings by suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import block_pairs, blocks, LIMIT, mark, runs, save, small, small_batches, sweep, tidy

#: Bytes that an anchor's hash takes in, a power of two.
GRAM = 32
#: Bytes of a text that are hashed at once; positions in one part fit the low bits.
PART, LOW = 1 << 19, np.uint64((1 << 20) - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


#: Starts in one run of an anchor at most; a longer run (low complexity) is cut.
RUN = 1 << 15
#: Positions that one lane of Kasai's pass goes through.
LANE = 128


def _gram_hashes(b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, by doubling; another one by salt."""
    h = (b.astype(np.uint64) + np.uint64(1 + 256 * salt)) * _MUL
    h ^= h >> np.uint64(31)
    n = 1
    while n < GRAM:
        h = (h[:-n] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[n:] * _MUL)
        h ^= h >> np.uint64(29)
        n *= 2
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row."""
    n = len(x) - w + 1
    out, done = x, 1
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out[:n]


def anchors(b: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, first, last, n: each start of a ``length``-byte string belongs to
    the anchor with the smallest hash inside the string, so equal strings have
    equal anchors at equal offsets. One row for a run of starts whose anchors
    have one hash: n places of it, many where a text repeats itself with a
    short period, so such a text gives one row for each RUN starts, not one a byte."""
    hashes, firsts = [], []
    w = length - GRAM + 1
    for at in range(0, max(0, len(b) - length + 1), PART):
        part = b[at : at + PART + length - 1]
        with np.errstate(over="ignore"):
            h = _gram_hashes(part, salt)
        low = _sliding_min((h & ~LOW) | np.arange(len(h), dtype=np.uint64), w)
        cut = np.append(0, np.flatnonzero(low[1:] != low[:-1]) + 1)
        hashes.append(low[cut] >> np.uint64(20))
        firsts.append(cut + at)
    if not hashes:
        return (np.zeros(0, np.int64),) * 4
    h, first = np.concatenate(hashes).astype(np.int64), np.concatenate(firsts).astype(np.int64)
    new = np.append(True, (h[1:] != h[:-1]) | (first[1:] // RUN != first[:-1] // RUN))
    at = np.flatnonzero(new)
    last = np.append(first[at[1:]], len(b) - length + 1) - 1
    return h[at], first[at], last, np.diff(np.append(at, len(h)))


class Suffixes:
    """The suffix array of many strings laid end to end, refined by doubling
    (Larsson-Sadakane: only groups that are still equal are sorted again) to a
    depth of ``length`` bytes. rank: equal where length bytes are equal; order:
    the starts of strings of length bytes, sorted, ties by place."""

    def __init__(self, parts: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(p) for p in parts], np.int64)
        self.text = np.frombuffer(b"".join(parts), np.uint8)
        self.part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        ends = np.cumsum(sizes)
        self.begin = ends - sizes
        left = ends[self.part] - np.arange(len(self.text))
        n = len(self.text)
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.eight = np.zeros(n, np.uint64)
        for k in range(8):
            self.eight = (self.eight << np.uint64(8)) | padded[k : k + n]
        del padded
        depth = min(8, length)
        rank = self._number(self.eight >> np.uint64(64 - 8 * depth), left >= depth)
        while depth < length:
            step = min(depth, length - depth)
            rank = self._refine(rank, step, left >= depth + step)
            depth += step
        self.rank = rank
        starts = np.flatnonzero(left >= length)
        self.order = starts[np.argsort(rank[starts], kind="stable")]

    @staticmethod
    def _number(key: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Ranks by key: a group's first place in the sorted order; -1 for suffixes that end before."""
        at = np.flatnonzero(whole)
        order = at[np.argsort(key[at], kind="stable")]
        sorted_ = key[order]
        first = np.append(True, sorted_[1:] != sorted_[:-1]) if len(order) else np.zeros(0, bool)
        rank = np.full(len(key), -1, np.int32)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return rank

    @staticmethod
    def _refine(rank: np.ndarray, step: int, whole: np.ndarray) -> np.ndarray:
        """Sorts each group of two or more by the rank of what follows step bytes later."""
        n = len(rank)
        at = np.flatnonzero(whole & (rank >= 0))
        size = np.bincount(rank[at], minlength=n + 1)
        out = np.full(n, -1, np.int32)
        single = size[rank[at]] == 1
        out[at[single]] = rank[at[single]]
        at = at[~single]
        if len(at):
            key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[at + step].astype(np.uint64)
            order = np.argsort(key)
            key, at = key[order], at[order]
            first = np.append(True, key[1:] != key[:-1])
            group = rank[at]
            start = np.append(True, group[1:] != group[:-1])
            place = np.arange(len(at))
            inside = place - np.maximum.accumulate(np.where(start, place, 0))
            out[at] = group + np.maximum.accumulate(np.where(first, place, 0)) - (place - inside)
        return out

    def kasai(self) -> np.ndarray:
        """For each place in the order the common prefix, up to length bytes,
        with the place before. Kasai's pass: in the order of the text, a start
        shares at least one byte less with its predecessor than the start
        before it did, so only the bytes beyond are compared. Lanes of LANE
        starts go side by side, and eight bytes are compared at once."""
        n, o, length = len(self.text), self.order, self.length
        place = np.full(n + 1, -1, np.int64)
        place[o] = np.arange(len(o))
        out = np.zeros(len(o), np.int64)
        bounds = np.array([1 << (8 * k) for k in range(1, 8)], np.uint64)
        base = np.arange(0, n, LANE)
        h, was = np.zeros(len(base), np.int64), np.full(len(base), -1, np.int64)
        for t in range(LANE):
            i = np.minimum(base + t, n)
            at = place[i]
            lane = np.flatnonzero((base + t < n) & (at > 0))
            j = o[at[lane] - 1]
            i = i[lane]
            # the bound holds if the last predecessor's next start comes before this one in the order
            after = place[np.minimum(was[lane] + 1, n)]
            k = np.where((was[lane] >= 0) & (after >= 0) & (after < at[lane]), np.maximum(h[lane] - 1, 0), 0)
            go = np.arange(len(lane))
            while len(go):
                x = self.eight[i[go] + k[go]] ^ self.eight[j[go] + k[go]]
                same = np.where(x == 0, 8, 7 - np.searchsorted(bounds, x, "right"))
                k[go] = np.minimum(k[go] + same, length)
                go = go[(same == 8) & (k[go] < length)]
            out[at[lane]] = k
            h[:], was[:] = 0, -1
            h[lane], was[lane] = k, j
        return out

    def repeated(self) -> np.ndarray:
        """The starts whose length bytes start elsewhere too: neighbours in the order with a whole common prefix."""
        o = self.order
        if len(o) < 2:
            return o[:0]
        same = self.kasai()[1:] >= self.length
        hit = np.zeros(len(o), bool)
        hit[:-1] |= same
        hit[1:] |= same
        return np.sort(o[hit])

    def strings(self, starts: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.text[starts[:, None] + np.arange(self.length)]).view(f"S{self.length}").ravel()

    def merged(self, other: Suffixes, chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """Starts here and starts in other that have equal strings: each string
        of other is looked up in the order here by binary search."""
        o, mine, theirs = self.order, [], []
        if not len(o) or not len(other.order):
            return o[:0], other.order[:0]
        mark = np.zeros(len(o) + 1, np.int64)
        for i in range(0, len(other.order), chunk):
            at = other.order[i : i + chunk]
            want = other.strings(at)
            lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(o), np.int64)
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, len(o) - 1)
                less = (self.strings(o[mid]) < want) & (lo < hi)
                lo = np.where(less, mid + 1, lo)
                hi = np.where(less, hi, np.minimum(hi, mid))
            found = np.flatnonzero(lo < len(o))
            found = found[self.strings(o[lo[found]]) == want[found]]
            theirs.append(at[found])
            mine.append(lo[found])
        first = np.unique(np.concatenate(mine))
        ranks = self.rank[o]
        end = np.searchsorted(ranks, ranks[first], "right")
        np.add.at(mark, first, 1)
        np.add.at(mark, end, -1)
        return np.sort(o[np.cumsum(mark)[:-1] > 0]), np.sort(np.concatenate(theirs))


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings from these sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    a, b = np.append(0, cut), np.append(cut, len(starts)) - 1
    return list(zip(starts[a].tolist(), (starts[b] + length).tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


PIECE = {"hash": pa.int64(), "uid": pa.int64(), "s": pa.int64(), "digest": pa.binary(), "text": pa.binary()}
KINDS = "hash long, uid long, s long, digest binary, text binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), PIECE.values(), strict=True)], list(PIECE))


def _held(step):
    """Batches of the rows that step gives for batches, of some 4 MB each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row in step(batches):
            out.append(row)
            size += len(row[-1]) + 100
            if size >= 4 << 20:
                yield _pieces(out)
                out, size = [], 0
        if out:
            yield _pieces(out)

    return run


def _find_anchors(length: int):
    """Anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, s, e, n = anchors(np.frombuffer(t, np.uint8), length)
                found.append((h, np.full(len(h), uid, np.int64), s, e, n))
            if found:
                cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                for i in range(0, len(cols[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], ["hash", "uid", "s", "e", "n"])

    return run


def _cut_known(length: int, wanted):
    """The pieces of text around the anchors in wanted, a broadcast sorted array."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = wanted.value
        for batch in batches:
            for uid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, s, e, _ = anchors(np.frombuffer(t, np.uint8), length)
                if len(h) and len(known):
                    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                    for hash_, a, b in zip(h[hit].tolist(), s[hit].tolist(), e[hit].tolist(), strict=True):
                        part = t[a : b + length]
                        yield hash_, uid, a, xxhash.xxh3_128_digest(part), part

    return _held(rows)


def _cut(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for uid, t, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for x in some:
                    part = t[x["s"] : x["e"] + length]
                    yield x["hash"], uid, x["s"], xxhash.xxh3_128_digest(part), part

    return _held(rows)


def _divide(length: int):
    """The pieces of a frequent anchor, cut by second anchors under another
    hash: equal strings have both alike. uid is unused, s the place in the piece."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for hash_, digest, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for h, a, b in zip(*(x.tolist() for x in anchors(np.frombuffer(t, np.uint8), length, 1)[:3]), strict=True):
                    yield xxhash.xxh3_64_intdigest(b"%d %d" % (hash_, h)) >> 20, 0, a, digest, t[a : b + length]

    return _held(rows)


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column(1).to_pylist():
            merged: list[dict] = []
            for a, b in sorted((x["a"], x["b"]) for x in spans):
                if merged and a <= merged[-1]["b"]:
                    merged[-1]["b"] = max(merged[-1]["b"], b)
                else:
                    merged.append({"a": a, "b": b})
            out.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], ["uid", "spans"])


def _shard(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            digests, texts, offs = group["digest"].to_pylist(), group["text"].to_pylist(), group["s"].to_pylist()
            mine, bi, bj = group["mine"].to_numpy(), group["bi"][0].as_py(), group["bj"][0].as_py()
            halves = []
            if bi == bj:
                s = Suffixes(texts, length)
                halves.append((s, s.repeated(), np.arange(len(texts))))
            else:
                at = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
                a, b = (Suffixes([texts[i] for i in x], length) for x in at)
                x, y = a.merged(b)
                halves += [(a, x, at[0]), (b, y, at[1])]
            for s, hit, at in halves:
                part = s.part[hit]
                cut = np.flatnonzero(np.diff(part)) + 1
                for run_ in np.split(hit, cut) if len(hit) else []:
                    p = s.part[run_[0]]
                    k = at[p]
                    yield pa.RecordBatch.from_arrays([pa.array([digests[k]], pa.binary()), pa.array([[{"a": x, "b": y} for x, y in _spans(run_ - s.begin[p] + offs[k], length)]], _SPANS)], ["digest", "spans"])

    return run


def _packed(step):
    """Joins the one-row batches of step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in step(batches):
            held.append(b)
            if len(held) >= 2000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def dedup_substrings(docs: DataFrame, text: str = "text", length: int = 200, shard_bytes: int = 1 << 20, block: int = 4096, broadcast_hashes: int = 4 << 20) -> DataFrame:
    """docs with kept (binary), n_bytes, n_removed and n_spans instead of text.

    Every byte is removed that a string of ``length`` bytes covers which also
    starts anywhere else, in the same document or another; strings are judged
    on the input. Texts count as UTF-8 bytes, and matches never cross texts.

    Equal texts collapse first: all bytes of a text that occurs twice go if it
    has ``length`` bytes. Each string belongs to an anchor inside it, the
    smallest hash of its 32-byte grams, so equal strings have equal anchors.
    Only anchors that occur twice stay, and the pieces of text around them go
    to shards by anchor: two equal strings meet in one shard, and equal pieces
    collapse. Each shard makes the suffix array of its pieces, by doubling in
    groups that are still equal, takes the common prefixes of neighbours by
    Kasai's pass, and reads off the strings with a neighbour of a whole common
    prefix. The pieces of an anchor with more than ``block`` different ones
    (a rule of signs, a very common phrase) are cut by second anchors; what
    has more than block again makes several shards, of which each two are
    merged by binary search.

    Null text is empty; texts under ``length`` bytes lose nothing. A text that
    repeats itself with a short period gives a piece for each 32768 bytes.
    Repeated rows are copies. Columns of those names are replaced.
    """
    small_batches(docs.sparkSession)
    since = mark()
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    rows = save(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "docs")
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit("")).cast("binary")
    long = rows.select("uid", body.alias("t")).where(F.octet_length("t") >= length)
    texts = save(long.select("uid", F.md5("t").alias("m"), F.octet_length("t").alias("size")), "digests")
    classes = save(texts.groupBy("m", "size").agg(F.min("uid").alias("cid"), F.count(F.lit(1)).alias("copies")), "classes")
    single = save(classes.where("copies = 1").select(F.col("cid").alias("uid")), "single")
    near = small(classes.select(F.col("cid").alias("uid")), 16)
    unique = rows.select("uid", body.alias("t")).join(near, "uid").select("uid", "t")
    if classes.count() * 16 > LIMIT:  # the join shuffles texts: once
        unique = save(unique, "unique")
    found = unique.mapInArrow(tidy(_find_anchors(length)), "hash long, uid long, s long, e long, n long")
    twice = save(found.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"), "twice")
    if twice.count() <= broadcast_hashes:
        known = np.sort(twice.toArrow()["hash"].to_numpy())  # 8 bytes each
        pieces = unique.mapInArrow(tidy(_cut_known(length, docs.sparkSession.sparkContext.broadcast(known))), KINDS)
    else:  # texts meet their anchors by shuffle
        near = found.join(twice, "hash").groupBy("uid").agg(F.collect_list(F.struct("hash", "s", "e")).alias("some"))  # at most a text's anchors
        pieces = unique.join(near, "uid").select("uid", "t", "some").mapInArrow(tidy(_cut(length)), KINDS)
    pieces = save(pieces, "pieces")
    once = pieces.groupBy("hash", "digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    once = save(once, "once")
    total = once.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    hot = save(once.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "hot")
    alone = once.select("hash", F.lit(0).cast("long").alias("s"), "digest", "text")
    if hot.count():
        few = small(hot.select("hash"), 16)
        divided = alone.join(few, "hash").select("hash", "digest", "text").mapInArrow(tidy(_divide(length)), KINDS)
        divided = save(divided.select("hash", "s", "digest", "text"), "divided")
        per = save(divided.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "divided_hot")
        rest = alone.join(few, "hash", "left_anti").withColumn("n", F.lit(None).cast("long"))
        keyed = rest.unionByName(divided.join(small(per, 32), "hash", "left"))
    else:
        keyed = alone.withColumn("n", F.lit(None).cast("long"))
    shard = F.when(F.col("n").isNull(), F.pmod(F.xxhash64("hash"), F.lit(n_shards))).otherwise(-F.col("hash") - 1)
    keyed = keyed.select(shard.cast("long").alias("shard"), blocks(F.coalesce("n", F.lit(1)), block).alias("nb"), F.xxhash64("digest", "s").alias("who"), "s", "digest", "text")
    met = block_pairs(keyed, "shard", "nb", "who").select("shard", "bi", "bj", "mine", "s", "digest", "text")
    met = met.repartition("shard", "bi", "bj").sortWithinPartitions("shard", "bi", "bj")
    spans = met.mapInArrow(tidy(_packed(_shard(length))), "digest binary, spans array<struct<a:long,b:long>>")
    spans = spans.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most a piece's spans by its blocks
    again = once.where("copies > 1").select("digest", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("text").cast("long").alias("b"))).alias("spans"))
    hits = save(spans.join(again.select("digest"), "digest", "left_anti").unionByName(again), "spans")
    gone = pieces.select("uid", "s", "digest").join(small(single, 16), "uid").join(small(hits, 160), "digest")
    gone = gone.select("uid", F.transform("spans", lambda x: F.struct((x["a"] + F.col("s")).alias("a"), (x["b"] + F.col("s")).alias("b"))).alias("spans"))
    gone = gone.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most a text's pieces
    gone = gone.mapInArrow(tidy(_merge_spans), "uid long, spans array<struct<a:long,b:long>>")
    copies = texts.join(small(classes.where("copies > 1").select("m", "size", "copies"), 64), ["m", "size"])
    copies = copies.select("uid", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("b"))).alias("spans"))
    gone = save(gone.unionByName(copies), "gone")
    sweep(docs.sparkSession, since, rows, gone)
    spread = gone.agg(F.coalesce(F.avg(F.size("spans")), F.lit(0))).first()[0]
    others = [c for c in docs.columns if c != text]
    out = rows.join(small(gone, 48 + round(24 * spread)), "uid", "left").select(*[F.col(f"row.`{c}`").alias(c) for c in others], body.alias("kept"), "spans")
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, lost, count = [], [], [], []
            for t, spans in zip(batch.column(len(others)).to_pylist(), batch.column(len(others) + 1).to_pylist(), strict=True):
                merged = [(x["a"], x["b"]) for x in spans or ()]
                at, left = 0, []
                for a, b in merged:
                    left.append(t[at:a])
                    at = b
                left.append(t[at:])
                kept.append(b"".join(left))
                size.append(len(t))
                lost.append(sum(b - a for a, b in merged))
                count.append(len(merged))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(count, pa.int64())], [f.name for f in schema])

    return out.mapInArrow(tidy(remove), schema)
