"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHES, small_batches, tidy

#: n-gram vectors that a worker keeps, one byte a dimension.
KEPT = 1 << 15
#: Bits of a letter's number in an n-gram's code.
BITS = 18


@lru_cache(1)
def _alphabet() -> np.ndarray:
    """A number for each letter by code point; 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.int32)
    letters = np.array([c for c in range(sys.maxunicode + 1) if chr(c).isalpha()])
    out[letters] = 1 + np.arange(len(letters))
    return out


class Profiles:
    """Vectors of letter trigrams: three random bipolar letter vectors, the
    first rotated twice and the second once, bound by multiplication. A
    letter's vector is drawn when it is first met, by a seed of its own."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.place = np.full(1 << BITS, -1, np.int64)
        self.letters = np.zeros((0, dims), np.int8)
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dims), np.int8)

    def letter(self, number: int) -> np.ndarray:
        return (np.random.default_rng([self.seed, number]).integers(0, 2, self.dims) * 2 - 1).astype(np.int8)

    def bound(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes >> 2 * BITS, (codes >> BITS) & ((1 << BITS) - 1), codes & ((1 << BITS) - 1)
        used = np.unique(np.concatenate([a, b, c]))
        new = used[self.place[used] < 0]
        if len(new):
            self.place[new] = len(self.letters) + np.arange(len(new))
            self.letters = np.concatenate([self.letters, [self.letter(x) for x in new.tolist()]])
        x, y, z = (self.letters[self.place[k]] for k in (a, b, c))
        return np.roll(x, 2, axis=1) * np.roll(y, 1, axis=1) * z

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Those of codes, from the table of what was bound before."""
        rows = self.rows
        new = [c for c in codes.tolist() if c not in rows]
        if len(rows) + len(new) > KEPT:
            return self.bound(codes)
        if new:
            while len(rows) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(rows) : len(rows) + len(new)] = self.bound(np.array(new))
            for c in new:
                rows[c] = len(rows)
        return self.table[[rows[c] for c in codes.tolist()]]


@lru_cache(4)
def _profiles(dims: int, seed: int) -> Profiles:
    CACHES["profiles"] = _profiles.cache_clear
    return Profiles(dims, seed)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the letter trigrams of the whole text, lower case;
    anything that is no letter is a word end."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slots = _alphabet()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    slots = np.concatenate([[0], slots, [0]]).astype(np.int64)
    stay = np.ones(len(slots), bool)
    stay[1:] = (slots[1:] != 0) | (slots[:-1] != 0)
    slots = slots[stay]
    codes = (slots[:-2] << 2 * BITS) | (slots[1:-1] << BITS) | slots[2:]
    return np.unique(codes[slots[1:-1] != 0], return_counts=True)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo 5 is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = 1024, seed: int = 7, max_langs: int = 4096) -> dict[str, np.ndarray]:
    """Prototype by language: the bundle of its documents' profiles, each at
    unit length, over all rows of docs with a language. Bundling is linear, so
    a task adds up n-gram weights and binds vectors once at its end; it sends
    one vector a language. max_langs bounds what reaches the driver; more
    labels raise an error. Nulls, empty texts and texts without letters teach
    nothing."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, float]] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = trigrams(t)
                if len(codes):
                    into = sums.setdefault(name, {})
                    share = np.sqrt(n) / np.sqrt(n.sum())
                    for c, w in zip(codes.tolist(), share.tolist(), strict=True):
                        into[c] = into.get(c, 0.0) + w
        for name, weights in sums.items():
            codes, w = np.fromiter(weights.keys(), np.int64), np.fromiter(weights.values(), np.float64)
            total = np.zeros(dims)
            for i in range(0, len(codes), 4096):
                total += w[i : i + 4096] @ _profiles(dims, seed).bound(codes[i : i + 4096]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = docs.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(tidy(bundle, "profiles"), "lang string, v array<double>")
    whole = F.round(F.col("x") * 1e6).cast("long")  # whole numbers: their sum doesn't hang on the order
    sums = rows.select("lang", F.posexplode("v").alias("pos", "x")).groupBy("lang", "pos").agg(F.sum(whole).alias("x"))
    out: dict[str, np.ndarray] = {}
    for name, pairs in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))).limit(max_langs + 1).collect():
        out[name] = np.array([p["x"] for p in pairs]) / 1e6
    if len(out) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", seed: int = 7, named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (or as named), the cosine of the whole text's profile
    and the nearest prototype (0 to 1). Null text and text without a letter
    is ``und`` with score 0, and so is everything if nothing was learned. Ties
    go to the language that sorts first. Columns of those names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*named)
    names = list(prototypes)
    dims = len(next(iter(prototypes.values()))) if names else 1
    unit = np.array([v / (np.linalg.norm(v) or 1) for v in prototypes.values()], np.float32).T if names else np.zeros((1, 0), np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((names, unit))
    column = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(named[0], T.StringType()), T.StructField(named[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = sent.value
        for batch in batches:
            best, score = [], []
            for t in batch.column(column).to_pylist():
                codes, n = trigrams(t)
                if not len(codes) or not names:
                    best.append("und")
                    score.append(0.0)
                    continue
                v = np.sqrt(n).astype(np.float32) @ _profiles(dims, seed).vectors(codes).astype(np.float32)
                cos = (v / max(float(np.linalg.norm(v)), 1e-9)) @ unit
                k = int(np.argmax(cos))
                best.append(names[k])
                score.append(min(1.0, max(0.0, float(cos[k]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [f.name for f in schema])

    return docs.mapInArrow(tidy(run, "profiles"), schema)


def floor(judged: DataFrame, languages: int, dims: int = 1024, text: str = "text", lang: str = "lang", low: float = 0.01, least: int = 20, named: tuple[str, str] = ("lang_pred", "score")) -> Column:
    """The score under which a text is in no learned language, by its length,
    from judged rows of known language (as predict gives them).

    Half way from the noise level, which the best of as many unrelated vectors
    passes once in a thousand, to the ``low`` quantile of the own-language
    cosine over all rows of judged. Longer texts score higher, so the quantile
    is taken by the power of two of the length; a class of under ``least``
    rows has the floor of the next shorter one, the shortest the noise level."""
    noise = float(np.sqrt(2 * np.log(1000 * max(1, languages)) / dims))
    size = F.floor(F.log2(F.length(text) + 1))
    own = judged.where(F.col(named[0]) == F.col(lang))
    classes = own.groupBy(size.alias("size")).agg(F.percentile_approx(named[1], low, 10000).alias("q"), F.count(F.lit(1)).alias("n")).collect()  # 32 at most
    out = F.lit(noise)
    for r in sorted(classes, key=lambda r: r["size"]):
        if r["n"] >= least:
            out = F.when(size >= r["size"], max(noise, (noise + r["q"]) / 2)).otherwise(out)
    return out
