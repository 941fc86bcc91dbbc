"""Quality rules: line labelling by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, forget, save, small_batches, tidy

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
NAMES = (
    "bias", "blank", "under_3_words", "under_8_words", "over_25_words", "some_symbols", "many_symbols", "upper_case",
    "digits", "ends_a_sentence", "doubled_mark", "separators", "repeats_a_line", "short_words", "long_words",
    "notice_words", "first_lines", "last_lines",
)
_DOUBLED = (b"!!", b"??", b"***", b"###", b"$$$", b"%%%", b"&&&")
#: Words of notices, menus and prompts around a text.
NOTICES = (b"license", b"licence", b"copyright", b"rights reserved", b"cookie", b"subscribe", b"newsletter", b"click here", b"log in", b"sign up", b"privacy policy", b"terms of")
_AT = {name: i for i, name in enumerate(NAMES)}


def line_features(lines: list[bytes]) -> np.ndarray:
    """One row of 0/1 features (NAMES) for each line."""
    out = np.zeros((len(lines), len(NAMES)), np.uint8)
    seen: set[bytes] = set()
    for i, x in enumerate(lines):
        s = x.strip(SPACE)
        n, words = len(s), len(s.split())
        if not n:
            out[i, :2] = 1
            continue
        symbols = n - len(s.translate(None, SYMBOLS))
        upper = n - len(s.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        digits = n - len(s.translate(None, b"0123456789"))
        low = s.lower()
        out[i, :-2] = (
            1, 0, words < 3, words < 8, words > 25, symbols > 0.02 * n, symbols > 0.1 * n, upper > 0.5 * n, digits > 0.2 * n,
            s[-1:] in b".!?", any(d in s for d in _DOUBLED), s.count(b" | ") >= 2, s in seen, n < 3.5 * words, n > 12 * words,
            any(w in low for w in NOTICES),
        )
        seen.add(s)
    out[:2, -2] = 1
    out[-2:, -1] = 1
    return out


def weak_labels(features: np.ndarray, shared: np.ndarray, quality: int) -> np.ndarray:
    """A label for each line of a document to learn from. Lines that repeat in
    it, that other documents share, of symbols or separators, shouted or with
    words of notices are boilerplate; the others have their document's label.
    A blank line has that of the line before it, at the head of the one after."""
    x = features.astype(bool)
    bad = shared | x[:, _AT["repeats_a_line"]] | x[:, _AT["many_symbols"]] | x[:, _AT["separators"]] | x[:, _AT["notice_words"]] | (x[:, _AT["upper_case"]] & x[:, _AT["doubled_mark"]])
    out = np.where(bad, 0, quality)
    full = np.flatnonzero(~x[:, _AT["blank"]])
    if not len(full):
        return np.full(len(out), quality)
    at = np.maximum(np.searchsorted(full, np.arange(len(out)), "right") - 1, 0)
    return out[full[at]]


@dataclass
class Crf:
    """Two labels, 1 for content: a weight by label and feature, one by pair of labels."""

    emit: np.ndarray
    step: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        score = features @ self.emit.T
        n = len(score)
        back = np.zeros((n, 2), np.int8)
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = score[0].tolist()
        for i, (x, y) in enumerate(score[1:].tolist(), 1):
            p, q, r, s = a + s00, b + s10, a + s01, b + s11
            back[i] = (q > p, s > r)
            a, b = (q if q > p else p) + x, (s if s > r else r) + y
        out = np.zeros(n, np.int8)
        out[-1] = b >= a
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def marginals(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels by line and expected steps, by forward-backward on
        the ratio of the two labels' weights."""
        score = features @ self.emit.T
        n = len(score)
        (s00, s01), (s10, s11) = np.exp(self.step - self.step.max()).tolist()
        e0, e1 = np.exp(score - score.max(axis=1, keepdims=True)).T.tolist()
        f, a, b = [], e0[0], e1[0]
        for i in range(n):
            if i:
                a, b = (a * s00 + b * s10) * e0[i], (a * s01 + b * s11) * e1[i]
            z = a + b
            a, b = a / z, b / z
            f.append((a, b))
        p, steps = np.empty((n, 2)), np.zeros(4)
        a, b = 1.0, 1.0
        for i in range(n - 1, -1, -1):
            x, y = f[i][0] * a, f[i][1] * b
            p[i] = x / (x + y), y / (x + y)
            if i:
                x, y = e0[i] * a, e1[i] * b
                u, v = f[i - 1]
                w = np.array((u * s00 * x, u * s01 * y, v * s10 * x, v * s11 * y))
                steps += w / w.sum()
                a, b = s00 * x + s01 * y, s10 * x + s11 * y
                a, b = a / (a + b), b / (a + b)
        return p, steps.reshape(2, 2)


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """Gradient ascent on the likelihood of (features, label by line) of whole texts."""
    crf = Crf(np.zeros((2, len(NAMES))), np.zeros((2, 2)))
    order = np.random.default_rng(3)
    for r in range(rounds if sequences else 0):
        step = rate / (1 + r)
        for k in order.permutation(len(sequences)):
            x, labels = sequences[k]
            x = x.astype(float)
            p, steps = crf.marginals(x)
            gold = np.eye(2)[labels]
            goal = np.bincount(labels[:-1] * 2 + labels[1:], minlength=4).reshape(2, 2)
            crf.emit += step * ((gold - p).T @ x / len(x) - decay * crf.emit)
            crf.step += step * ((goal - steps) / len(x) - decay * crf.step)
    if not sequences:  # nothing learned: all is content
        crf.emit[1, 0] = 1.0
    return crf


def _hashes(text: bytes | None) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.strip(SPACE)) for x in (text or b"").split(b"\n")), np.uint64).view(np.int64)


def _holders(docs: DataFrame, known: np.ndarray) -> dict[int, int]:
    """In how many of all documents each known line (a hash) stands."""
    sent = docs.sparkSession.sparkContext.broadcast(np.unique(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        count = np.zeros(len(known), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and len(known):
                    h = np.unique(_hashes(t))
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    count[at[known[at] == h]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(known[count > 0]), pa.array(count[count > 0])], ["h", "n"])

    found = docs.mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return {r["h"]: r["n"] for r in found.collect()}  # at most the sample's lines


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = 2000, sample_lines: int = 400_000, shared: int = 10) -> Crf:
    """Fits on whole texts of at most ``sample`` rows of labels (doc_id,
    quality 0/1), half of either kind, those with the smallest hash of their
    id, as long as they have sample_lines lines in all. This bounded sample is
    the only one: in how many documents its lines stand is counted over all of
    docs (``shared`` or more make a line boilerplate), and every document is
    judged whole."""
    picked = None
    for q in (0, 1):
        part = labels.where((F.col("quality") == q) & F.col(doc_id).isNotNull()).select(doc_id, F.col("quality").alias("q")).dropDuplicates([doc_id])
        part = part.orderBy(F.xxhash64(doc_id), doc_id).limit(sample // 2)
        picked = part if picked is None else picked.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = [line_features((t or b"").split(b"\n")).tobytes() for t in texts]
            h = [_hashes(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(h, pa.binary()), batch.column(1)], ["x", "h", "q"])

    body = docs.select(F.col(text).alias("t"), doc_id)
    chosen = save(body.join(F.broadcast(picked), doc_id).select("t", "q", F.xxhash64(doc_id, "t").alias("k")), "sample")  # at most sample ids
    lines = F.coalesce(F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    upto = F.sum(lines).over(Window.orderBy("k", "t").rowsBetween(Window.unboundedPreceding, 0))  # one task, sample rows
    few = chosen.withColumn("upto", upto).where(F.col("upto") <= sample_lines).limit(2 * sample)
    rows = few.select(F.col("t").cast("binary"), "q", "k").mapInArrow(tidy(run), "x binary, h binary, q int").collect()
    forget(chosen)
    rows = [(np.frombuffer(r["x"], np.uint8).reshape(-1, len(NAMES)), np.frombuffer(r["h"], np.int64), int(r["q"])) for r in rows]
    n = _holders(body.select(F.col("t").cast("binary")), np.concatenate([h for _, h, _ in rows])) if rows else {}
    often = np.array(sorted(h for h, k in n.items() if k >= shared), np.int64)
    return fit([(x, weak_labels(x, np.isin(h, often), q)) for x, h, q in rows])


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    pair = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    hit = count[at] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


def measures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    b = text or b""
    words = b.split()
    solid = b.translate(None, SPACE)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    lines = [x for x in b.split(b"\n") if x.strip(SPACE)]
    return len(words), chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "content_share": "double", "kept": "boolean"}


def judge(docs: DataFrame, crf: Crf, text: str = "text", min_words: int = 50, max_repeat: int = 50, min_content: float = 0.5) -> DataFrame:
    """docs with the base measures, base_failed, content_share and kept.

    base_failed: under min_words words, or over max_repeat percent of them in
    repeated three-word windows. Viterbi decoding of the field marks each line
    of the whole text as content or boilerplate; content_share is the share of
    words in content lines. kept: not base_failed, and a share of at least
    min_content. Null and empty text have no word, share 0, and fail. Columns
    of those names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*COLUMNS)
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    column = docs.columns.index(text)
    kinds = {"long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType()}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, kinds[t]) for c, t in COLUMNS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for batch in batches:
            rows = []
            for t in batch.column(column).to_pylist():
                b = t.encode() if isinstance(t, str) else t
                m = measures(b)
                failed = m[0] < min_words or 100 * m[4] > max_repeat * m[0]
                share = 0.0
                if m[0]:
                    lines = (b or b"").split(b"\n")
                    words = np.array([len(x.split()) for x in lines])
                    share = float(words[crf.viterbi(line_features(lines)) == 1].sum() / words.sum())
                rows.append((*m, failed, share, not failed and share >= min_content))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for c, t in zip(cols, COLUMNS.values(), strict=True))], [f.name for f in schema])

    return docs.mapInArrow(tidy(run), schema)
