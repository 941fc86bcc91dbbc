"""The stages: what each takes from what the one before kept."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as cp
from linkloom.llm.common import save, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = [r.doc_id for r in docs.collect()]
    kept, cols = {"": first}, docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        assert docs.columns == cols
        kept[name] = [r.doc_id for r in docs.collect()]
    assert set(kept["language"]) <= set(first) and len(kept["language"]) >= 0.9 * len(first)
    assert sorted(kept["line_dedup"]) == sorted(kept["language"])
    assert len(set(kept["ngram_join"])) == len(kept["ngram_join"]) < len(kept["line_dedup"])
    assert set(kept["mixing"]) <= set(kept["ngram_join"])
    assert {r.doc_id for r in cp.run(spark, sf_dir).collect()} == set(kept["mixing"])


def test_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_unlearned_language(spark, sf_dir):
    """Documents of a language that no label names are dropped, the others stay."""
    docs = table(spark, sf_dir, "documents")
    hidden = docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    count = lambda d: {r[0]: r[1] for r in d.join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").groupBy(F.col("true") == "es").count().collect()}
    before, after = count(hidden), count(cp.known_language(spark, hidden, sf_dir))
    assert before[True] >= 10 and after.get(True, 0) <= 0.2 * before[True] and after[False] >= 0.97 * before[False]


LONG = " ".join(f"that{i % 700} the of and" for i in range(30_000))


def test_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and very long texts, ties, repeated rows and a clashing column beside real documents."""
    real = table(spark, sf_dir, "documents")
    odd = [(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, LONG, "en", None, None), (-3, LONG, None, "s", 1), (-3, LONG, None, "s", 1), (-4, "\n\n", "en", "s", 2), (None, LONG, "en", "s", 3)]
    docs = real.unionByName(spark.createDataFrame(odd, real.schema)).withColumn("kept", F.lit("x")).withColumn("copies", F.lit(9)).withColumn("score", F.lit("y"))
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        assert docs.columns == [*real.columns, "kept", "copies", "score"]
        assert [tuple(r) for r in docs.select("kept", "copies", "score").distinct().collect()] == [("x", 9, "y")]
        kept[name] = [r.doc_id for r in docs.where("doc_id IS NULL OR doc_id < 0").collect()]
    assert sorted(map(str, kept["language"])) == ["-2", "-3", "-3", "None"]  # texts without a letter go
    assert sorted(map(str, kept["line_dedup"])) == ["-2", "-3", "-3", "None"]
    assert kept["ngram_join"] == [-3]  # copies: the smallest doc_id stays, once
    assert docs.where("coalesce(text, '') = ''").count() == 0
    copies = kept["mixing"].count(-3)
    ends = cp.STAGES[-1][1](spark, docs, sf_dir).where("doc_id = -3 AND start = 0").count()
    assert set(kept["mixing"]) <= {-3} and copies <= 3 and ends == copies


def test_intermediates_go(spark, sf_dir, tmp_path):
    """run() leaves only what its result reads; sweep() the rest of it too."""
    from linkloom.llm import common

    common.sweep(spark)
    out = cp.run(spark, sf_dir)
    assert out.count() and len(common._SAVED) <= 3
    common.sweep(spark)
    assert common._SAVED == []
