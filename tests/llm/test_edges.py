"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import embeddings, language, line_dedup, quality
from linkloom.llm.embeddings import near_vectors
from linkloom.llm.licenses import COMMON, TEMPLATES, scan
from linkloom.llm.line_dedup import dedup_lines
from linkloom.llm.mixing import mix
from linkloom.llm.ngram_join import near_duplicates
from linkloom.llm.packing import Packer, pack
from linkloom.llm.queries import tokenizer_path
from linkloom.llm.sharding import shard
from linkloom.llm.suffix_dedup import anchors, dedup_substrings, Suffixes

from .test_queries import covered, licences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, uid long, size long, kept boolean, score string"
LONG = " ".join(f"wort{i % 5000}ä" for i in range(60000))
TEXTS = [(1, None), (2, ""), (3, "a\nb\n a \n"), (3, "a\nb\n a \n"), (None, "Ünder the MIT license, x"), (5, LONG), (6, LONG), (None, None), (7, "\x00\n\r\t"), (8, "🙂" * 300)]
ROWS = [(d, t, None if i % 3 == 0 else "aa", None if i % 2 else "s", None, "k", "r", 4, 5, None, "z") for i, (d, t) in enumerate(TEXTS)]


def learned(d):
    return language.predict(d, language.learn(d))


def judged(d):
    labels = d.sparkSession.createDataFrame([(5, 1), (3, 0), (None, 1), (6, None)], "doc_id long, quality int")
    return quality.judge(d, quality.learn(d, labels))


OPS = {
    "mix": mix,
    "shard": shard,
    "lines": dedup_lines,
    "lines_first": lambda d: dedup_lines(d, min_docs=2, keep_first=True),
    "lines_join": lambda d: dedup_lines(d, min_docs=2, broadcast_bytes=0),
    "lines_ranges": lambda d: dedup_lines(d, min_docs=2, max_bits=1 << 10),
    "substrings": dedup_substrings,
    "language": learned,
    "ngrams": near_duplicates,
    "licenses": scan,
    "quality": judged,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", OPS)
def test_one_row_a_document(docs, name):
    out = OPS[name](docs)
    assert len(out.columns) == len(set(out.columns))
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(repr(d) for d, _ in TEXTS)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(docs, name):
    assert OPS[name](docs.where("false")).collect() == []


def test_pack(docs):
    out = pack(docs, tokenizer_path()).collect()
    assert {r.doc_id for r in out} == {d for d, _ in TEXTS}
    assert sum(r.length for r in out if r.doc_id == 2) == 1  # the end token alone
    assert pack(docs.where("false"), tokenizer_path()).collect() == []


def test_values(docs):
    assert {(r.doc_id, r.n_dropped) for r in dedup_lines(docs, min_docs=2).where("doc_id = 3").collect()} == {(3, 3)}
    got = {r.doc_id: r for r in dedup_substrings(docs).collect() if r.doc_id}
    assert got[5].n_removed == got[5].n_bytes > 0 and got[5].n_spans == 1 and got[8].n_removed == got[8].n_bytes == 1200
    near = {r.doc_id: r for r in near_duplicates(docs).collect() if r.doc_id}
    assert (near[5].kept, near[6].kept, near[6].class_id, near[6].n_links) == (True, False, 5, 1)
    assert {r.labels for r in scan(docs).where("text IS NULL" if "text" in scan(docs).columns else "n_words = 0").collect()} == {""}
    assert {r.lang_pred for r in learned(docs).where("coalesce(text, '') = ''").collect()} == {"und"}


def test_reruns_agree(docs):
    take = lambda: sorted(repr((r.doc_id, r.taken)) for r in mix(docs).collect())
    assert take() == take()


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [1.0, 0.01]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0])]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(d.drop("n_links")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 8: (2, 1, False)} | {k: (0, k, True) for k in (3, 4, 5, 6, 7, 9, 10)}
    assert near_vectors(d.where("false")).collect() == []


def test_magnitudes(spark):
    """Tiny and huge components, repeated and null keys, and columns of the result's names."""
    rows = [(1, [1e-200, 1e-198]), (2, [1e-198, 1e-200]), (3, [2e-200, 2e-198]), (4, [1e200, 1e308]), (5, [1e-3, 1e100]), (6, [-1e308, 1e308]), (6, [-1e308, 1e308]), (None, [1e308, 1.1e308]), (None, [0.0, 0.0])]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, n_links string, cid string")
    got = sorted((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in near_vectors(d).collect())
    assert got == sorted([("1", 3, 1, True), ("2", 0, 2, True), ("3", 3, 1, False), ("4", 3, 1, False), ("5", 3, 1, False), ("6", 1, 6, True), ("6", 1, 6, True), ("None", 0, None, None), ("None", 0, None, None)])


def test_saturated_clusters(spark):
    """Two clusters of 15 and 14 vectors, 0.96 apart: every list of 10 is full of its own cluster."""
    rows = [(i, [1.0, 0.001 * i, 0.0]) for i in range(15)] + [(15 + i, [0.96, 0.0, 0.28 + 0.001 * i]) for i in range(14)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    links = ((unit @ unit.T) >= 0.95).sum(1) - 1
    assert links.min() > 14  # links lead across
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(d).collect()}
    assert got == {i: (int(links[i]), 0, i == 0) for i, _ in rows}


def test_audit_by_vector(spark):
    """A large group that is found does not hide small ones that are missed."""
    true = [(i, j) for i in range(40) for j in range(40) if i != j] + [(100, 101), (101, 100), (200, 201), (201, 200)]
    groups = spark.createDataFrame([(i, 0) for i in range(40)], "node long, label long")
    recall = embeddings._recall(spark.createDataFrame(true, "u long, v long"), groups, 10)
    assert recall == 0.0 and len(true) * 0.98 <= 40 * 39


def test_blocks_of_pairs(spark):
    """A chain of groups compared in many small blocks, against brute force."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((6, 8))[rng.integers(0, 6, 400)] + 0.12 * rng.standard_normal((400, 8)), rng.standard_normal((100, 8))])
    d = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors(d, block_bytes=1).collect()}
    assert got == dict(enumerate(links.tolist())) and links.max() > 50


def test_many_near_copies(spark):
    """Near copies and bystanders, in small blocks and in one: links as by brute force."""
    words_ = [f"w{i}" for i in range(120)]
    rng = np.random.default_rng(6)
    texts = []
    for i in range(300):
        w = list(words_)
        for j in rng.integers(0, 120, i % 5):
            w[j] = f"x{i}_{j}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{i}_{j}" for j in range(60)) for i in range(50)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = [sum(10 * len(a & b) >= 8 * len(a | b) for b in sets) - 1 for a in sets]
    for block in (16, 2048):
        assert {r.doc_id: r.n_links for r in near_duplicates(d, block=block, bucket=64).collect()} == dict(enumerate(links))


def test_filters_by_range(spark, monkeypatch):
    """With filters far too small for all lines at once, suspects stay near the true repeats and results alike."""
    rows = [(i, "\n".join([f"line {i} {j}" for j in range(20)] + [f"shared {i % 50}"])) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = d.select(F.col("text").cast("binary").alias("t"))
    assert 50 <= line_dedup.suspects_by_range(texts, 21_000, 1, 1 << 13).count() <= 50 + 0.05 * 20_000
    for limit in (1 << 20, 0):
        monkeypatch.setattr(line_dedup, "LIMIT", limit)
        got = [(r.n_lines, r.n_dropped) for r in dedup_lines(d, max_bits=1 << 13).collect()]
        assert got == [(21, 1)] * 1000


def test_kasai():
    """Common prefixes of neighbours in the order by comparing bytes."""
    rng = np.random.default_rng(8)
    parts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (500, 3, 900, 40)] + [b"a" * 300, b"ab" * 200, b"xyz" * 100] * 2
    for length in (5, 8, 40, 64):
        s = Suffixes(parts, length)
        text = s.text.tobytes()
        o = s.order.tolist()
        assert o == sorted(o, key=lambda i: (text[i : i + length], i))
        wanted = [0] + [next((k for k in range(length) if text[a + k] != text[b + k]), length) for a, b in zip(o, o[1:], strict=False)]
        assert s.kasai().tolist() == wanted


def test_low_complexity(spark):
    """Five MB of one byte, short periods and rules of signs among texts: few pieces, results as by brute force."""
    h, s, e, n = anchors(np.full(5_000_000, 97, np.uint8), 200)
    assert len(h) < 200 and n.sum() == 5_000_000 - 199 and e[-1] + 200 == 5_000_000
    rng = np.random.default_rng(9)
    word = lambda k: bytes(rng.integers(97, 123, k).astype(np.uint8)).decode()
    body = word(600)
    texts = {i: word(150) + "=" * 80 + word(150) for i in range(60)}
    texts |= {100: "ab" * 1500, 101: "abc" * 700 + word(30), 102: word(40) + "ab" * 120, 103: "a" * 40_000, 104: "a" * 200, 105: "a" * 199}
    texts |= {200 + i: body[:i] + "#" + body[i:] for i in range(0, 600, 7)} | {400: body, 401: body}
    wanted = covered({d: t.encode() for d, t in texts.items()}, 200)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (4, 4096):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in dedup_substrings(d, block=block).collect()}
        assert got == {k: w[:3] for k, w in wanted.items()}


def test_missed_links(spark, monkeypatch):
    """A search that finds nothing ends in the comparison of all pairs."""
    monkeypatch.setattr(embeddings, "_descend", lambda graph, *_: graph.limit(0))
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 1.0]), (5, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(d).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_all_notices(spark):
    """One file that holds the notice of every template, and prose with rarer words around a common one."""
    rare = "affero universal dedication domain unencumbered mozilla lesser sharealike noncommercial cc0"
    rows = [(1, " filler ".join(t.text for t in TEMPLATES)), (2, f"{rare} prose distributed under the bsd license {rare}")]
    rows += [(i, "license software public permission general gnu bsd") for i in range(3, 30)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == ",".join(sorted({t.label for t in TEMPLATES}))
    assert (got[2].labels, got[2].score, got[3].labels) == ("bsd", 1.0, "")


def test_notices_by_brute_force(spark):
    """Notices whole, cut at either end and with a word changed, in files with other notices."""
    texts = []
    for t in TEMPLATES:
        w = t.text.split()
        texts += [t.text, " ".join(w[1:]), " ".join(w[:-1]), " ".join([*w[: len(w) // 2], "odd", *w[len(w) // 2 + 1 :]]), f"{t.text} x {TEMPLATES[5].text} {t.text}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan(d).collect()}
    for i, t in enumerate(texts):
        more = licences(t.split(), TEMPLATES, COMMON)
        assert set(got[i].labels.split(",")) - {""} == set(more) | (set(got[i].base_labels.split(",")) - {""})
        assert got[i].n_base or got[i].score == pytest.approx(max(more.values(), default=0.0))


def test_no_file_is_shuffled(docs):
    plan = scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def windows(packer):
    out = {}
    for _, start, ids, n, sid, _, tier in packer.take():
        out.setdefault((sid, tier), []).append((start, len(ids), n))
    return out


def test_tiers(spark):
    """Pieces stay in their tier, or fill gaps of longer ones; only the rest of a task is shorter than all tiers."""
    tiers = (256, 512, 1024, 2048)
    packer = Packer(tiers, room=20000, first_id=0)
    for i in range(2000):
        packer.add(i, np.zeros((200, 230, 180, 240, 1, 400, 450, 480, 700, 1500)[i * 7 % 10], "<u4"))
    packer.flush(last=True)
    got = windows(packer)
    assert all(sum(n for _, n, _ in ps) == tier for (_, tier), ps in got.items())
    used = [tier for _, tier in got]
    assert all(used.count(t) > 20 for t in tiers) and sum(t not in tiers for t in used) <= 8
    whole = [(tier, max(n for _, n, _ in ps)) for (_, tier), ps in got.items() if tier > 256]
    assert sum(2 * n <= tier for tier, n in whole) <= 0.05 * len(whole)  # opened by a piece of the tier itself


def test_special_tokens(spark):
    """Ids of texts with strings of special tokens equal the tokenizer's."""
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|><|startoftext|>Y é.", "<|ENDOFTEXT|> a", "<|endoftext|", "á<|endoftext|>\u0301b", "", "\x1c<|endoftext|>\n", None, "<|endoftext|> " * 5000]
    coder = Tokenizer.from_file(tokenizer_path())
    d = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, length int, task int")
    got = {}
    for r in sorted(pack(d, tokenizer_path()).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: [*coder.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_step_groups(docs):
    """Over all tasks, the step groups of a tier are as few as can be and alike in size."""
    rows = pack(docs.repartition(4), tokenizer_path(), step_sequences=8).select("sequence_id", "tier", "step_group").distinct().collect()
    by_tier = {}
    for r in rows:
        by_tier.setdefault(r.tier, []).append(r.step_group)
    for tier, groups in by_tier.items():
        sizes = [groups.count(g) for g in set(groups)]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == -(-len(groups) * tier // (8 * 2048))
    assert len({r.step_group for r in rows}) == sum(len(set(g)) for g in by_tier.values())


def chains(crf, x):
    """Every labelling of a short text and its score."""
    for path in itertools.product((0, 1), repeat=len(x)):
        yield path, sum(crf.emit[y] @ v for y, v in zip(path, x, strict=True)) + sum(crf.step[a, b] for a, b in itertools.pairwise(path))


def test_field_by_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7):
        crf = quality.Crf(rng.normal(size=(2, len(quality.NAMES))), rng.normal(size=(2, 2)))
        x = rng.integers(0, 2, (n, len(quality.NAMES))).astype(float)
        scored = list(chains(crf, x))
        assert tuple(crf.viterbi(x)) == max(scored, key=lambda s: s[1])[0]
        weights = np.exp([s for _, s in scored])
        paths = np.array([p for p, _ in scored])
        p, steps = crf.marginals(x)
        assert np.allclose(p[:, 1], weights @ paths / weights.sum())
        wanted = [[sum(w * sum(s == (a, b) for s in itertools.pairwise(path)) for path, w in zip(paths.tolist(), weights, strict=True)) / weights.sum() for b in (0, 1)] for a in (0, 1)]
        assert np.allclose(steps, wanted)


def test_planted_boilerplate(spark):
    """Heads and tails of menus and notices around good texts are told from them, line by line."""
    rng = np.random.default_rng(2)
    say = lambda: " ".join("abcdefghij"[i] * 3 + "klmnopqrst"[j] for i, j in rng.integers(0, 10, (14, 2))).capitalize() + "."
    menu, tail = ["Home | News | Sport | Shop | Help | More", "Log in | Sign up | Cookies | Privacy policy"], ["Subscribe to our newsletter! Click here", "Copyright 2020 Example. All rights reserved."]
    good, junk = [], []
    for i in range(60):
        body = [say() for _ in range(6)]
        good.append("\n".join([*menu, *body, *tail] if i % 2 else body))
        junk.append("\n".join([" ### ".join(say().upper().split()) + "!!" for _ in range(6)]))
    d = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    crf = quality.learn(d, spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int"))
    label = lambda lines: crf.viterbi(quality.line_features([x.encode() for x in lines])).tolist()
    body = [say() for _ in range(7)]
    assert label([*menu, *body, *tail]) == [0, 0, *[1] * 7, 0, 0]
    assert label(body) == [1] * 7 and not any(label(junk[0].split("\n")))
    got = {r.doc_id: r for r in quality.judge(d, crf, min_words=10).collect()}
    for i, t in enumerate(good + junk):
        lines = t.split("\n")
        words_ = [len(x.split()) for x in lines]
        assert got[i].content_share == sum(n for n, y in zip(words_, label(lines), strict=True) if y) / sum(words_)
        assert got[i].kept == (i < 60)
