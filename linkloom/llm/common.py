"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as every operator here reads it: space and tab to CR.
SPACE = b" \t\n\x0b\x0c\r"


#: Folders that save() wrote in this process, oldest first.
_SAVED: list[str] = []
#: Bytes of one Arrow batch. A batch ends after the row that passes this.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local
    master (tests) gets a temporary one; a cluster, whose machines would each
    write their own, an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def save(df: DataFrame, tag: str = "part") -> DataFrame:
    """Writes df under the shared folder and reads it again: lineage ends here,
    and what follows survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkloom/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    _SAVED.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._linkloom_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _SAVED:
        _SAVED.remove(path)


def forget(df: DataFrame) -> None:
    """Deletes what save() wrote; df is of no use afterwards."""
    path = getattr(df, "_linkloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def mark() -> int:
    """A point from which sweep() deletes."""
    return len(_SAVED)


def sweep(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Deletes all that save() wrote after the mark but for the tables to keep.
    Without a mark: all of this process, once its results are written."""
    held = {getattr(k, "_linkloom_path", None) for k in keep}
    for path in _SAVED[since:]:
        if path not in held:
            _delete(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """df if it only picks rows and columns of stored tables, whose partitions
    come again alike when a lost task is repeated; else a saved copy."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while True:
        kind = plan.getClass().getSimpleName().rstrip("$")
        if kind in ("LogicalRelation", "LocalRelation"):
            return df
        if kind not in ("Project", "Filter") or not plan.deterministic():
            return save(df, "input")
        plan = plan.children().head()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes, since one text may be megabytes. The setting
    is the session's; a smaller one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_sum(df: DataFrame, order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Adds out: the sum of value over all rows with a smaller order (a dense
    non-negative integer). Two levels, so that no task holds more than a
    block's rows or one row a block."""
    blk = F.floor(F.col(order) / block)
    sums = df.groupBy(blk.alias("__blk")).agg(F.sum(value).alias("__sum"))
    w = Window.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__blk", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__blk", blk)
        .join(sums, "__blk")
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("__blk", "__base")
    )


def md5_60(col: Column) -> Column:
    """The first 60 bits of md5 as a non-negative long."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("long")


#: Bytes that small() broadcasts at most.
LIMIT = 32 << 20


def small(df: DataFrame, row_bytes: int, limit: int = LIMIT) -> DataFrame:
    """df, marked for broadcast if its counted rows take at most limit bytes;
    otherwise Spark joins by shuffle. df should be a saved table."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def release() -> None:
    """Gives what the worker has freed back to the machine: idle workers of earlier stages hold no memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What operators keep in a worker between tasks: how to drop it, by owner.
CACHES: dict[str, Callable[[], None]] = {}


def tidy(step, owner: str = ""):
    """step for mapInArrow. What other operators keep in this worker goes first
    (workers outlive stages), and the worker's free memory at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [k for k in CACHES if k != owner]:
            CACHES.pop(other)()
        try:
            yield from step(batches)
        finally:
            release()

    return run


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """One table for each run of rows with equal first n_keys (long) columns.
    Rows come sorted by them; a run may span batches, and one is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = keys[a].tolist()
            if held and k != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k
    if held:
        yield pa.Table.from_batches(held)


def blocks(sizes: Column, most: int) -> Column:
    """Into how many blocks a group of so many rows is split."""
    return F.greatest(F.lit(1), F.ceil(sizes / most)).cast("long")


def block_pairs(df: DataFrame, key: str, n_blocks: str, member: str) -> DataFrame:
    """Each row once for every pair of blocks (bi <= bj) that its own block is
    in, so that each two members of a group meet in one (key, bi, bj). mine:
    the row's block. A group of one block gives each row once."""
    mine = F.pmod(F.xxhash64(member, F.lit(5)), F.col(n_blocks))
    out = df.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_blocks) - 1)))
    return out.withColumn("bi", F.least("mine", "other")).withColumn("bj", F.greatest("mine", "other")).drop("other")


class Forest:
    """Union-find over 0..n-1; links() has one edge for each successful union."""

    def __init__(self, n: int):
        self.up, self.made = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.made.append((a, b))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, label (the smallest node that edges reach) for all nodes of
    edges. Each round gives every node the smallest of itself and its
    neighbours and contracts the graph to those, until no edge is left: a
    logarithmic number of rounds, each written to the shared folder. The graph
    stays distributed; only counts reach the driver."""
    live = edges.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    live = save(live, "edges")
    nodes = live.select(F.col("u").alias("node")).union(live.select("v")).distinct()
    labels = save(nodes.select("node", F.col("node").alias("label")), "labels")
    while live.count():
        both = live.union(live.select("v", "u"))
        low = save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")), "low")
        fit = small(low, 32)
        old = labels
        labels = save(labels.join(fit.select(F.col("u").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        forget(old)
        a = live.join(fit.select("u", F.col("to").alias("a")), "u").select("a", "v")
        b = a.join(fit.select(F.col("u").alias("v"), F.col("to").alias("b")), "v").where("a <> b")
        old = live
        live = save(b.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        forget(old)
        forget(low)
    return labels
