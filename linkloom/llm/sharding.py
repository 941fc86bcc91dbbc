"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sum, save, stored


def _read_all(df: DataFrame, text: str) -> tuple[int, int]:
    size = F.coalesce(F.octet_length(F.col(text).cast("binary")), F.lit(0)) + 1
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return int(n), int(b)


def shard(
    docs: DataFrame,
    n_shards: int = 8,
    text: str = "text",
    seed: int = 17,
    bucket_bytes: int = 4 << 20,
    write_to: str | None = None,
    max_buckets: int = 200_000,
) -> DataFrame:
    """The rows of docs with shard (0 to n_shards - 1) and slot (gapless from
    0 in each shard), in a seeded random order; law ``rows``: the numbers of
    rows in two shards differ by one at most.

    Pass one scatters the records over buckets of about bucket_bytes by seeded
    hashes. The hash takes the whole row and the row's place in its input
    partition, so neither equal rows nor a hot key gather in one bucket; an
    input that is no stored table is written first, so that a repeated task
    scatters its rows alike. Each bucket is one task of pass two, whose number
    is the bucket's: it sorts the bucket by a hash, shuffles it (Fisher-Yates,
    Spark's ``shuffle``, which seeds itself by the task's number) and writes
    it to the shared folder. So the order hangs on the input's rows, files and
    seed, not on the number of shuffle partitions. Buckets laid end to end are
    one permutation of the table; shard k is the k-th of n_shards equal cuts.

    There are at most max_buckets buckets (about 0.5 GB each at 100 TB), so the
    list of their starts, 16 bytes each, is always small enough to broadcast.

    Nulls and empty texts are rows like others. Fewer rows than shards leave
    some shards empty; an empty table gives an empty result. Columns named
    shard or slot in docs are replaced. write_to: also writes the shards as
    Parquet, one folder a shard.
    """
    docs = stored(docs)
    n, total = _read_all(docs, text)
    n_buckets = max(1, min(-(-total // bucket_bytes), max_buckets))
    place = F.monotonically_increasing_id()
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"], place)
    scattered = docs.select(F.pmod(hashed, F.lit(n_buckets)).cast("int").alias("bucket"), F.xxhash64(hashed, F.lit(seed)).alias("tie"), F.struct("*").alias("row"))
    buckets = scattered.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").agg(F.collect_list(F.struct("tie", "row")).alias("rows"))
    # sorted first, so that the outcome doesn't hang on the order in which blocks arrive
    dealt = F.shuffle(F.array_sort("rows", lambda a, b: F.when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0)), seed)
    written = save(buckets.select("bucket", F.size("rows").cast("long").alias("n"), dealt.alias("rows")), "buckets")
    starts = save(prefix_sum(written.select("bucket", "n"), "bucket", "n", "start").select("bucket", "start"), "starts")
    rows = written.join(F.broadcast(starts), "bucket").select("start", F.posexplode("rows").alias("at", "r"))
    least, more = divmod(n, n_shards)
    at = F.col("start") + F.col("at")
    cut = more * (least + 1)  # the first shards hold one row more
    if least:
        which = F.when(at < cut, F.floor(at / (least + 1))).otherwise(more + F.floor((at - cut) / least))
        slot = F.when(at < cut, at % (least + 1)).otherwise((at - cut) % least)
    else:
        which, slot = at, F.lit(0)
    out = rows.select(
        *[F.col(f"r.row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")],
        which.cast("int").alias("shard"), slot.cast("long").alias("slot"),
    )
    if write_to:
        out.write.partitionBy("shard").parquet(write_to)
    return out
