"""Hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, save, small, small_batches, tidy
from .tokens import word_ids


PIECES = (
    "doc_key long, start long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "tier int, task int, rank long"
)


class Packer:
    """Packs documents of one task. tiers: ascending context sizes, powers of
    two but for the last. Memory holds at most ``room`` tokens at a time."""

    def __init__(self, tiers: tuple[int, ...], room: int, first_id: int):
        self.tiers, self.room = tiers, room
        self.next_id, self.held = first_id, 0
        self.left: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        """Whole windows of a long document go out at once; the rest waits."""
        top, n = self.tiers[-1], len(ids)
        cut = n - n % top
        for at in range(0, cut, top):
            self._emit(top, [(key, at, ids[at : at + top], n)])
        if cut < n:
            self.left.append((key, cut, ids[cut:].copy(), n))  # a view would hold the whole document
            self.held += n - cut
        if self.held >= self.room:
            self.flush()

    def _emit(self, tier: int, pieces: list[tuple]) -> None:
        sid, self.next_id, at = self.next_id, self.next_id + 1, 0
        for key, start, ids, n in pieces:
            self.out.append((key, start, ids, n, sid, at, tier))
            at += len(ids)

    def _window(self, longest: int, total: int, last: bool) -> int:
        """Size of the next window; 0 if what is left has to wait."""
        tier = next(t for t in self.tiers if t >= longest)
        if total >= tier:
            return tier
        if total >= self.tiers[0]:  # too little for the tier: its pieces are split over shorter ones
            return max(t for t in self.tiers if t <= total)
        return 1 << (total.bit_length() - 1) if last else 0

    def flush(self, last: bool = False) -> None:
        """Longest tier first: each window is of the shortest tier that holds
        the longest piece left, opens with it and takes from the shorter tiers
        what fits its gap best; the last bit of a gap takes the head of a
        piece, whose tail goes back to its tier. Less than the shortest tier
        stays for the next flush; the last one leaves nothing."""
        left = sorted(self.left, key=lambda p: len(p[2]))
        sizes = [len(p[2]) for p in left]
        total = sum(sizes)
        while left and (tier := self._window(sizes[-1], total, last)):
            gap, window = tier, []
            while gap:
                i = bisect_right(sizes, gap) - 1
                if i >= 0:
                    piece = left.pop(i)
                    sizes.pop(i)
                else:
                    key, start, ids, n = left.pop(0)
                    sizes.pop(0)
                    piece, tail = (key, start, ids[:gap], n), (key, start + gap, ids[gap:], n)
                    j = bisect_right(sizes, len(tail[2]))
                    left.insert(j, tail)
                    sizes.insert(j, len(tail[2]))
                window.append(piece)
                gap -= len(piece[2])
                if not left:
                    break
            total -= tier - gap
            self._emit(tier, window)
        self.left, self.held = left, total

    def take(self) -> list[tuple]:
        """Rows so far."""
        rows, self.out = self.out, []
        return rows


def _groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of documents that have ``most`` characters together at most, or of one longer document."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = t or ""
            if texts and size + len(t) > most:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(k)
            texts.append(t)
            size += len(t)
    if texts:
        yield keys, texts


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    key: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    end_id: int = 1,
    step_sequences: int = 64,
    room: int = 1 << 20,
) -> DataFrame:
    """One row for each piece: key, start, ids (little-endian 32-bit), length,
    doc_tokens, sequence_id, offset, tier, step_group.

    Every task packs the documents it reads, so no text is shuffled: full
    windows of the top tier are cut from long documents, other pieces open
    windows of the shortest tier that holds them, longest first, with gaps
    filled from the shorter tiers. What is left at the end of a task, less
    than the shortest tier, makes sequences of power-of-two length, whose tier
    is that length, so nothing is padded. Memory in a task is ``room`` tokens, an
    Arrow batch, and the ids of documents of 2^21 characters together or of
    one longer document.

    A step group holds sequences of one tier, of all tasks, that together have
    at most step_sequences * top tokens. The pieces are written once to count
    them; each tier has as few groups as hold its sequences, and their sizes
    differ by one sequence at most.

    Null text is the empty text: the end token alone. Null and repeated keys
    are packed like others. Strings of special tokens in a text get their ids.
    Other columns of docs, clashing ones too, are not part of the result. The
    file of the tokenizer is on every machine at tokenizer_file. sequence_id is the task's number times 2^36 plus a count,
    so the input should be a stored table, whose partitions come again alike.
    """
    top = tiers[-1]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = word_ids(tokenizer_file)
        end = np.asarray([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        packer = Packer(tiers, room, part << 36)
        used: dict[int, tuple[int, int]] = {}

        def rows() -> pa.RecordBatch | None:
            got = packer.take()
            if not got:
                return None
            ranks = []
            for *_, sid, _, tier in got:
                s = sid - (part << 36)
                if tier not in used or used[tier][0] != s:
                    used[tier] = (s, used.get(tier, (0, -1))[1] + 1)
                ranks.append(used[tier][1])
            cols = list(zip(*got, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([x.tobytes() for x in cols[2]], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int32()), pa.array([part] * len(got), pa.int32()), pa.array(ranks, pa.int64())],
                ["doc_key", "start", "ids", "doc_tokens", "sequence_id", "offset", "tier", "task", "rank"],
            )

        for keys, texts in _groups(batches):
            for k, ids in zip(keys, coder.ids(texts), strict=True):
                packer.add(k, np.frombuffer(ids + end, "<u4"))
                if len(packer.out) >= 2048 and (b := rows()):
                    yield b
            if b := rows():
                yield b
            release()  # else a worker keeps what the largest groups took
        packer.flush(last=True)
        if b := rows():
            yield b

    out = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(tidy(run, "tokens"), PIECES)
    out = save(out, "pieces")
    each = out.where("offset = 0").groupBy("task", "tier").count()
    whole = Window.partitionBy("tier")
    before = F.coalesce(F.sum("count").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.greatest(F.lit(1), F.floor(step_sequences * top / F.col("tier")))
    each = each.select("task", "tier", before.alias("before"), F.sum("count").over(whole).alias("n"))
    each = save(each.withColumn("groups", F.ceil(F.col("n") / most)), "tiers")
    out = out.join(small(each, 40), ["task", "tier"])
    out = out.withColumn("step_group", (F.floor((F.col("before") + F.col("rank")) * F.col("groups") / F.col("n")) * (top + 1) + F.col("tier")).cast("long"))
    return out.select(
        F.col("doc_key").alias(key), "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens",
        "sequence_id", "offset", "tier", "step_group",
    )


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
