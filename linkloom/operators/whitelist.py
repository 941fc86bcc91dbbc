"""Allow-lists of names, addresses and address ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cidr_bounds, ipv4_int
from .staging import bounded

SNI, CIDR, IP = 1, 2, 4


def sni_list(lines: DataFrame, col: str = "value") -> DataFrame:
    """Names in lower case; # is a character like others."""
    return lines.select(F.lower(F.trim(col)).alias("sni")).where("sni <> ''").distinct()


def ip_list(lines: DataFrame, col: str = "value") -> DataFrame:
    return lines.select(ipv4_int(F.trim(col)).alias("ip")).where("ip IS NOT NULL").distinct()


def cidr_list(lines: DataFrame, col: str = "value") -> DataFrame:
    """Disjoint lo, hi: malformed lines go, overlapping and nested ranges merge.
    The window runs over the list of ranges by /8, never over servers."""
    b = cidr_bounds(F.trim(col))
    rows = lines.select(b.alias("b")).where("b IS NOT NULL").select("b.lo", "b.hi")
    return merge_ranges(rows)


def merge_ranges(rows: DataFrame) -> DataFrame:
    cut = rows.withColumn("oct", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))))
    cut = cut.select("oct", F.greatest("lo", F.shiftleft("oct", 24)).alias("lo"), F.least("hi", F.shiftleft(F.col("oct") + 1, 24) - 1).alias("hi")).distinct()
    w = Window.partitionBy("oct").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = cut.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
    grouped = marked.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("oct", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("oct", "lo", "hi")


def _spread(key: Column, row: Column) -> Column:
    """key for a left join, with rows that have none dealt over many keys that match nothing."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("\x00"), F.pmod(row, F.lit(1 << 20)).cast("string")))


def _listed(df: DataFrame, key: str, rows: DataFrame, value: str, out: str, spread: str) -> DataFrame:
    """df with out: whether key is in rows; by broadcast while rows are few, else by shuffle."""
    few = bounded(rows, 64)
    if few is not None:
        return df.join(few.select(F.col(value).alias(key), F.lit(True).alias(out)), key, "left")
    many = rows.select(F.col(value).cast("string").alias("__k"), F.lit(True).alias(out))
    return df.withColumn("__k", _spread(F.col(key), F.col(spread))).join(many, "__k", "left").drop("__k")


def in_ranges(df: DataFrame, ip: str, ranges: DataFrame, out: str) -> DataFrame:
    """df with out: whether ip lies in a range. Ranges are cut at each /16 and
    are disjoint, so an address meets one at most. Few of them are broadcast
    and looked up by /16. Else the distinct addresses and the range starts are
    laid in order within each /16, and the last start at or before an address
    decides: an as-of lookup, no nested loop."""
    cut = ranges.withColumn("net", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))))
    cut = cut.select("net", F.greatest("lo", F.shiftleft("net", 16)).alias("at"), F.least("hi", F.shiftleft(F.col("net") + 1, 16) - 1).alias("end"))
    few = bounded(cut, 64)
    if few is not None:
        near = few.select(F.col("net").alias("__net"), F.col("at").alias("__lo"), F.col("end").alias("__hi"))
        work = df.withColumn("__n", F.shiftright(F.col(ip), 16))
        work = work.join(near, (F.col("__n") == F.col("__net")) & F.col(ip).between(F.col("__lo"), F.col("__hi")), "left")
        return work.withColumn(out, F.col("__lo").isNotNull()).drop("__n", "__net", "__lo", "__hi")
    starts = cut.select("net", "at", F.lit(0).alias("kind"), "end")
    asked = df.select(F.col(ip).alias("at")).where(F.col(ip).isNotNull()).distinct()
    both = asked.select(F.shiftright("at", 16).alias("net"), "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end")).unionByName(starts)
    end = F.last("end", ignorenulls=True).over(Window.partitionBy("net").orderBy("at", "kind"))
    hit = both.withColumn("e", end).where("kind = 1 AND at <= e").select(F.col("at").cast("string").alias("__k"), F.lit(True).alias("__hit"))
    row = F.xxhash64(*[F.col(c) for c, t in df.dtypes if "map<" not in t])
    return df.withColumn("__k", _spread(F.col(ip), row)).join(hit, "__k", "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit", "__k")


def with_flags(df: DataFrame, host: Column, sni: Column, snis: DataFrame | None, ips: DataFrame | None, ranges: DataFrame | None, out: str = "flags") -> DataFrame:
    """df with a bit mask: SNI if the sni or the host name is listed, IP and
    CIDR if the IPv4 host is. Any list missing: all flags are 0. Lists that a
    count shows to be small are broadcast, so no server is shuffled."""
    if snis is None or ips is None or ranges is None:
        return df.withColumn(out, F.lit(0))
    work = df.withColumn("__h", F.lower(host)).withColumn("__s", F.lower(sni)).withColumn("__ip", ipv4_int(host))
    work = work.withColumn("__r", F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t]))
    work = _listed(_listed(work, "__h", snis, "sni", "__a", "__r"), "__s", snis, "sni", "__b", "__r")
    work = _listed(work, "__ip", ips, "ip", "__c", "__r")
    work = in_ranges(work, "__ip", ranges, "__d")
    bit = lambda c, v: F.when(c, v).otherwise(0)
    no = F.lit(False)
    flags = bit(F.coalesce("__a", no) | F.coalesce("__b", no), SNI).bitwiseOR(bit(F.coalesce("__d", no), CIDR)).bitwiseOR(bit(F.coalesce("__c", no), IP))
    return work.withColumn(out, flags).select(*[c for c in df.columns if c != out], out)
