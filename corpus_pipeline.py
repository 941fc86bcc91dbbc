"""A corpus pipeline: language, shared lines, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of docs, extra ones unchanged, whatever
their names. An empty table gives an empty one. Rows with a null id, source or
language are documents like others; repeated rows are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import language
from linkloom.llm.common import mark, save, small_batches, sweep, table
from linkloom.llm.line_dedup import dedup_lines
from linkloom.llm.mixing import mix
from linkloom.llm.ngram_join import near_duplicates
from linkloom.llm.packing import pack
from linkloom.llm.queries import tokenizer_path


#: The columns that stages work on; others are held apart, so that no operator's own columns meet them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    others = [c for c in docs.columns if c not in COLUMNS]
    return docs.select(*COLUMNS, F.struct(*[F.col(f"`{c}`") for c in others]).alias("__others")) if others else docs


def _whole(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs."""
    return out.select(*[F.col(c) if c in COLUMNS else F.col(f"__others.`{c}`").alias(c) for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learned profile
    resembles: score under the floor that the learned documents give. Null
    and empty texts have no letter; a null language teaches nothing."""
    small_batches(spark)
    named = ("__lang", "__score")
    profiles = language.learn(docs.where(~language.held_out("doc_id")))
    judged = save(language.predict(_apart(docs), profiles, named=named), "judged")
    floor = language.floor(judged.where(~language.held_out("doc_id")), len(profiles), named=named)
    return _whole(judged.where((F.col("__lang") != "und") & (F.col("__score") >= floor)), docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that ten documents or more hold; every document stays,
    one without a line left as the empty text. n_chars follows the text."""
    small_batches(spark)
    out = dedup_lines(_apart(docs), min_docs=10, min_chars=1)
    return _whole(out.withColumn("n_chars", F.length("text").cast("long")), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the
    smallest id (null last), or one of several with that id. Texts without
    words are in no group and stay."""
    small_batches(spark)
    return _whole(near_duplicates(_apart(docs), n=5, threshold=0.8).where("kept"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most; texts
    without words not at all. Equal rows are taken or left together."""
    small_batches(spark)
    taken = mix(_apart(docs)).where("copies > 0")
    return _whole(taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a text of any length is cut."""
    small_batches(spark)
    return pack(docs, tokenizer_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


STAGES = [
    ("language", known_language),
    ("line_dedup", shared_lines),
    ("ngram_join", near_copies),
    ("mixing", mixture),
    ("packing", packing),
]

#: Profiles, MinHash and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage saved on its way, and the table it read, goes
    once its own result is written."""
    docs = table(spark, sf_dir, "documents")
    since = mark()
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        sweep(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
