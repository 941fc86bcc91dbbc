"""The training-data queries: SQL where it can say them, else brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from linkloom.llm import queries
from tests.oracle import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", ["op1_mixing", "op3_line_dedup", "op4_suffix_dedup", "op7_embeddings", "op9_licenses"])
def test_matches_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


def test_op8(spark, sf_dir, docs):
    """Brute force over all pairs of word shingles."""
    sets = {}
    for d, t in docs.items():
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    near = {d: [e for e in ids if e != d and sets[d] and sets[e] and len(sets[d] & sets[e]) * 10 >= 8 * len(sets[d] | sets[e])] for d in ids}
    for r in queries.op8_ngram_join(spark, sf_dir).collect():
        reach, todo = {r.doc_id}, [r.doc_id]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in reach and not reach.add(x)]
        assert (r.n_links, r.class_id, r.kept) == (len(near[r.doc_id]), min(reach), min(reach) == r.doc_id)


def test_op2(spark, sf_dir, docs):
    rows = queries.op2_sharding(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(docs))
    for r in rows:
        b = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def covered(texts: dict, length: int) -> dict:
    seen = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[d] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_op4(spark, sf_dir, docs):
    wanted = covered({d: (t or "").encode() for d, t in docs.items()}, 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, sf_dir).collect()}
    assert got == wanted and sum(w[1] for w in wanted.values()) > 0


def test_op5(spark, sf_dir, docs):
    """An exact round trip through the tokenizer."""
    import numpy as np
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer_path())
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for d, rs in pieces.items():
        ids = [*coder.encode(docs[d] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= total * 0.01


def test_op6(spark, sf_dir, docs):
    """Accuracy on the held-out documents, and the split."""
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    rows = queries.op6_language(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs)
    right = n = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in docs[r.doc_id] or ""):
            assert r.lang_pred == "und"
        elif r.held_out and lang[r.doc_id]:
            right, n = right + (r.lang_pred == lang[r.doc_id]), n + 1
    assert n and right / n >= 0.9


def test_op6_by_brute_force(spark, sf_dir, docs):
    """Profiles and cosines letter by letter, from the texts."""
    import numpy as np

    from linkloom.llm import language

    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    number = {c: i + 1 for i, c in enumerate(x for x in map(chr, range(0x110000)) if x.isalpha())}
    p = language.Profiles(1024, 7)
    vector: dict[str, np.ndarray] = defaultdict(lambda: None)
    letter = {}

    def one(gram):
        if vector[gram] is None:
            v = [letter.setdefault(c, p.letter(number.get(c, 0)).astype(float)) for c in gram]
            vector[gram] = np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return vector[gram]

    def profile(t):
        words_ = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (t or "").lower()))
        n = Counter(f" {w} "[i : i + 3] for w in words_ for i in range(len(w)))
        return sum((k**0.5 * one(g) for g, k in n.items()), np.zeros(1024)), sum(n.values())

    known = defaultdict(lambda: np.zeros(1024))
    mine = {d: profile(t) for d, t in docs.items()}
    for d, (v, n) in mine.items():
        if lang[d] is not None and n and zlib.crc32(str(d).encode()) % 5:
            known[lang[d]] += v / n**0.5
    for r in queries.op6_language(spark, sf_dir).collect():
        v, n = mine[r.doc_id]
        cos = {k: float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)) for k, u in known.items()} if n else {}
        best = max(sorted(cos), key=cos.get, default="und")
        assert r.lang_pred == best or cos[best] - cos[r.lang_pred] < 1e-4
        assert r.score == pytest.approx(min(1, max(0, cos.get(best, 0.0))), abs=1e-4)


def licences(w, templates, common, least=2):
    """label -> largest share, by trying every template at every place."""
    out = {}
    for t in templates:
        parts = t.text.split()
        keys = [(next(i for i in range(len(parts)) if parts[i : i + len(k.split())] == k.split()), k.split()) for k in t.key]
        need = min(least, len(set(parts) - common))
        for off in range(-len(parts), len(w)):
            if all(off + i >= 0 and w[off + i : off + i + len(k)] == k for i, k in keys):
                here = [x for j, x in enumerate(parts) if 0 <= off + j < len(w) and w[off + j] == x]
                if len(set(here) - common) >= need:
                    out[t.label] = max(out.get(t.label, 0), len(here) / len(parts))
    return out


def test_op9(spark, sf_dir, docs):
    from linkloom.llm.licenses import COMMON, TEMPLATES

    base = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for r in queries.op9_licenses(spark, sf_dir).collect():
        low = (docs[r.doc_id] or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        first, last = (min(at)[0], max(at)[0]) if at else (None, None)
        labels = {x[1] for x in at}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), first, last, ",".join(sorted(labels)))
        more = licences(w, TEMPLATES, COMMON)
        assert r.labels == ",".join(sorted(labels | set(more)))
        assert r.score == pytest.approx(1.0 if at else max(more.values(), default=0.0))


def test_op10(spark, sf_dir, docs):
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    right = n = 0
    for r in queries.op10_quality(spark, sf_dir).collect():
        t = docs[r.doc_id] or ""
        w = WORD.findall(t)
        spots = defaultdict(list)
        for i in range(len(w) - 2):
            spots[tuple(w[i : i + 3])].append(i)
        repeat = len({i + k for s in spots.values() if len(s) > 1 for i in s for k in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        wanted = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == wanted
        assert not (failed and r.kept)
        if quality.get(r.doc_id) is not None and not failed:
            right, n = right + (r.kept == bool(quality[r.doc_id])), n + 1
    assert n and right / n >= 0.6
