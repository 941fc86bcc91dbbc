"""Removal of lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LIMIT, save, small_batches, SPACE, tidy

#: Bytes of a filter's page, the unit in which filters are merged.
PAGE = 8192
PROBES = 3


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, A-Z lowered."""
    return [x.strip(SPACE) for x in (text or b"").lower().split(b"\n")]


def _doc_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    keys = set(line_keys(text))
    keys.discard(b"")
    return {k for k in keys if len(k.decode("utf-8", "replace")) >= min_chars} if min_chars > 1 else keys


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def _has(filt: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filt[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _put(filt: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filt, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def _hash(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64)


def _filters(bits: int, min_chars: int):
    """A task's two filters: hashes seen once, and those seen again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys: list[bytes] = []
            for text in batch.column(0).to_pylist():
                keys.extend(_doc_keys(text, min_chars))
            if keys:
                h, n = np.unique(_hash(keys), return_counts=True)
                at = _places(h, bits)
                again = _has(once, at) | (n > 1)
                _put(twice, at[:, again])
                _put(once, at)
        for p in range(0, bits // 8, PAGE):
            a, b = once[p : p + PAGE], twice[p : p + PAGE]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([p // PAGE], pa.int64()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["page", "once", "twice"])

    return build


def _merge(group: pa.Table) -> pa.Table:
    """Seen again: again in one task, or once in two."""
    once, twice = np.zeros(PAGE, np.uint8), np.zeros(PAGE, np.uint8)
    for a, b in zip(group["once"].to_pylist(), group["twice"].to_pylist(), strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        twice |= b | (once & a)
        once |= a
    return pa.table({"page": [group["page"][0].as_py()], "twice": pa.array([twice.tobytes()], pa.binary())})


def twice_seen(texts: DataFrame, bits: int, min_chars: int, tasks: int) -> bytes:
    """The merged second filter over the one column of texts: bits / 8 bytes."""
    pages = texts.coalesce(tasks).mapInArrow(tidy(_filters(bits, min_chars)), "page long, once binary, twice binary")
    merged = save(pages.groupBy("page").applyInArrow(_merge, "page long, twice binary"), "filter")
    out = np.zeros(bits // 8, np.uint8)
    for page, data in merged.toLocalIterator():  # bits / 8 bytes in all, whatever the corpus
        out[page * PAGE : (page + 1) * PAGE] = np.frombuffer(data, np.uint8)
    return out.tobytes()


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _line_hashes(min_chars: int, window: int = 1 << 20):
    """The 64-bit hash of each key of each document, repeats inside a window
    of keys once with again = true."""

    def flush(hashes: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(hashes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], ["h", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(_hash(_doc_keys(t, min_chars)))
                size += len(held[-1])
                if size >= window:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _range_suspects(bits: int):
    """Of a range of hashes, those seen again, by two Bloom filters: each once, and few more that only look so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            raw = batch.column(0).to_numpy().view(np.uint64)
            again = batch.column(1).to_numpy(zero_copy_only=False)
            h, at, n = np.unique(raw, return_inverse=True, return_counts=True)
            more = n > 1
            more[at[again]] = True
            at = _places(h, bits)
            hit = (more | _has(once, at)) & ~_has(twice, at)
            _put(twice, at[:, hit])
            _put(once, at)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64))], ["h"])

    return run


def _candidates(is_suspect, min_chars: int):
    """Hash and digest of each key of each document whose hash is_suspect says may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            for t in batch.column(0).to_pylist():
                keys.extend(_doc_keys(t, min_chars))
            if keys:
                h = _hash(keys)
                hit = np.flatnonzero(is_suspect(h))
                for i in range(0, len(hit), 1 << 16):
                    part = hit[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array([_digest(keys[j]) for j in part.tolist()], pa.binary())], ["h", "key"])

    return run


def suspects_by_range(texts: DataFrame, lines: int, min_chars: int, max_bits: int) -> DataFrame:
    """h: the hashes that two documents have, and few more. Every hash goes to
    the range it lies in; a range has filters of max_bits for as many hashes
    as they hold at 12 bits each, so filters of any corpus stay this small."""
    ranges = -(-12 * lines // max_bits)
    hashes = texts.mapInArrow(tidy(_line_hashes(min_chars)), "h long, again boolean")
    return save(hashes.repartition(ranges, "h").mapInArrow(tidy(_range_suspects(max_bits)), "h long").distinct(), "suspects")


def shared_keys(docs: DataFrame, text: str, min_docs: int, min_chars: int, max_bits: int, tasks: int) -> DataFrame:
    """key, n: the digests of the line keys that at least min_docs documents hold."""
    texts = docs.select(F.col(text).cast("binary").alias("t"))
    newline = F.coalesce(F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    lines = docs.agg(F.sum(newline)).first()[0] or 0
    bits = 1 << 19
    while bits < max_bits and bits < 12 * lines:
        bits *= 2
    spark = docs.sparkSession
    kinds = "h long, key binary"
    if min_docs < 2:
        found = texts.mapInArrow(tidy(_candidates(lambda h: np.ones(len(h), bool), min_chars)), kinds)
    elif 12 * lines <= max_bits:
        filt = spark.sparkContext.broadcast(twice_seen(texts, bits, min_chars, tasks))
        found = texts.mapInArrow(tidy(_candidates(lambda h: _has(np.frombuffer(filt.value, np.uint8), _places(h, bits)), min_chars)), kinds)
    else:
        known = suspects_by_range(texts, lines, min_chars, max_bits)
        if known.count() * 8 <= LIMIT:
            sent = spark.sparkContext.broadcast(np.sort(known.toArrow()["h"].to_numpy()).view(np.int64))
            found = texts.mapInArrow(tidy(_candidates(lambda h: _among(h.view(np.int64), sent.value), min_chars)), kinds)
        else:  # 24 bytes a line meet the suspects by shuffle
            found = texts.mapInArrow(tidy(_candidates(lambda h: np.ones(len(h), bool), min_chars)), kinds).join(known, "h", "left_semi")
    found = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return save(found.where(F.col("n") >= min_docs), "keys")


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    max_bits: int = 1 << 28,
    tasks: int = 2048,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """docs with text without its shared lines, n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z
    lowered. Keys of min_chars code points or more that min_docs documents
    hold lose their lines in every document; with keep_first the line stays at
    its first place in the document with the smallest (partition, row).

    Each task fills two Bloom filters, for hashes seen once and seen again;
    merging sends what two tasks saw once to the second. They take 12 bits a
    line. Where that is over max_bits (32 MB), hashes of 8 bytes go to ranges
    instead, each with two filters of max_bits. Only keys that a second filter
    holds are shuffled, as 128-bit digests, and counted exactly, so a false
    positive costs time, never a line. The dropped keys are broadcast if they
    take broadcast_bytes or less; otherwise lines join them.

    Null or empty text is one empty line, which stays; null comes back as the
    empty text. Equal rows count as separate documents. Columns named n_lines
    or n_dropped in docs are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keys = shared_keys(docs, text, min_docs, min_chars, max_bits, tasks)
    size = keys.agg(F.count(F.lit(1))).first()[0] * 80
    docs = docs.drop("n_lines", "n_dropped")
    if keep_first or size > broadcast_bytes:
        return _by_join(docs, text, keys, keep_first)
    held = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in keys.select("key").toLocalIterator()))

    def gone(t: bytes) -> list[bool]:
        return [_digest(k) in held.value for k in line_keys(t)]

    return _drop(docs.withColumn(text, F.col(text).cast("binary")), text, docs, lambda t, _: gone(t))


def _drop(rows: DataFrame, text: str, docs: DataFrame, which) -> DataFrame:
    """The columns of docs, of rows, without the lines that which(text, gone) marks; gone: rows' last column."""
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    column, width = docs.columns.index(text), len(docs.columns)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for t, places in zip(batch.column(column).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                t = t or b""
                gone = which(t, places)
                n = sum(gone)
                kept.append(b"\n".join(x for x, out in zip(t.split(b"\n"), gone, strict=True) if not out) if n else t)
                lines.append(len(gone))
                dropped.append(n)
            arrays = list(batch.columns[:width])
            arrays[column] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [f.name for f in schema])

    return rows.mapInArrow(tidy(drop), schema)


def _by_join(docs: DataFrame, text: str, keys: DataFrame, keep_first: bool) -> DataFrame:
    """As dedup_lines, for key sets of any size: the lines join the keys."""
    numbered = save(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "docs")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ks = line_keys(t)
                for i in range(0, len(ks), 1 << 16):
                    part = ks[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(part), pa.int64()), pa.array(range(i, i + len(part)), pa.int32()), pa.array([_digest(k) for k in part], pa.binary())], ["uid", "pos", "key"])

    split = numbered.select("uid", F.col(f"row.`{text}`").cast("binary").alias("t")).mapInArrow(tidy(lines), "uid long, pos int, key binary")
    hits = save(split.join(keys.select("key"), "key"), "hits")
    if keep_first:
        first = hits.groupBy("key").agg(F.min(F.struct("uid", "pos")).alias("f"))
        hits = hits.join(first, "key").where(F.struct("uid", "pos") != F.col("f"))
    gone = save(hits.groupBy("uid").agg(F.collect_set("pos").alias("gone")), "gone")  # at most a document's lines
    cells = [(F.col(f"row.`{c}`").cast("binary") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    rows = numbered.join(gone, "uid", "left").select(*cells, F.col("gone").alias("__gone"))

    def marked(t: bytes, places: list[int] | None) -> list[bool]:
        out = [False] * (t.count(b"\n") + 1)
        for i in places or ():
            out[i] = True
        return out

    return _drop(rows, text, docs, marked)
