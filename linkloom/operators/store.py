"""Tables with first-seen semantics: sources, servers, sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import stable64

SOURCES = "id long, url string"
SERVERS = (
    "id long, schema string, host string, port string, transport string, security string, remarks string, raw_config string, "
    "first_seen_ts long, first_seen_source_id long, sig long, flags int, flags_ts long, ping string, ping_ts long"
)
SIGHTINGS = "id long, server_id long, source_id long, seen_ts long, remarks string"
FIRST = ("first_seen_ts", "first_seen_source_id", "remarks", "flags", "flags_ts")
FIXED = ("schema", "host", "port", "transport", "security", "raw_config", "sig")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of whole commits under path, oldest first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted(n for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/servers/_SUCCESS")))


def tags(spark: SparkSession, path: str) -> set[str]:
    """The micro-batches that whole commits under path hold."""
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    marked = [f"{path}/{v}/tag" for v in versions(spark, path) if at(path).getFileSystem(conf).exists(at(f"{path}/{v}/tag"))]
    return {r.tag for r in spark.read.schema("tag string").parquet(*marked).collect()} if marked else set()  # one row a commit


def get_server(servers: DataFrame, server_id: int) -> DataFrame:
    """The server of an id, all 15 columns: one row or none."""
    return servers.where(F.col("id") == server_id)


def source_type(url: Column) -> Column:
    return F.when(url.rlike("^https?://t\\.me/"), "telegram").when(url.rlike("^https?://"), "subscription").otherwise("other")


def source_rows(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.where(F.col(url).isNotNull()).select(stable64(F.col(url)).alias("id"), F.col(url).alias("url")).dropDuplicates(["id"])


def upsert_sources(old: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """old and the urls it lacks; a url keeps its id."""
    return old.unionByName(source_rows(urls, url).join(old.select("id"), "id", "left_anti"))


def fk_violations(rows: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is missing."""
    return rows.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def first_seen(arrivals: DataFrame, key: str = "server_id", ts: str = "seen_ts", seq: str = "seq") -> DataFrame:
    """One row a key: what the earliest sighting says (ties: the earliest
    arrival) in FIRST, what the first arrival says in FIXED. min_by combines on
    the map side, so a hot key is one partial row a task."""
    seen, came = F.struct(ts, seq), F.col(seq)
    aggs = [F.min_by(F.struct(*[c for c in FIRST if c in arrivals.columns]), seen).alias("__f"), F.min_by(F.struct(*[c for c in FIXED if c in arrivals.columns]), came).alias("__a")]
    out = arrivals.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("n_sightings"))
    return out.select(key, "__f.*", "__a.*", "n_sightings")


def merge_servers(old: DataFrame, arrivals: DataFrame) -> DataFrame:
    """servers after arrivals (server_id, seq, seen_ts and the columns of FIRST
    and FIXED): new ids are inserted; a sighting strictly earlier than the
    stored one rewrites FIRST alone; pings stay. One shuffle on the id."""
    new = first_seen(arrivals.withColumn("first_seen_ts", F.col("seen_ts")).withColumn("first_seen_source_id", F.col("source_id"))).drop("n_sightings")
    new = new.select(F.col("server_id").alias("id"), *[F.col(c).alias(f"n_{c}") for c in (*FIRST, *FIXED)])
    both = old.join(new, "id", "full_outer")
    fresh = old["schema"].isNull()
    earlier = F.coalesce(F.col("n_first_seen_ts") < old["first_seen_ts"], F.lit(False))
    pick = lambda c: F.when(fresh | (earlier if c in FIRST else F.lit(False)), F.col(f"n_{c}")).otherwise(old[c]).alias(c)
    return both.select(*[pick(c) if c in (*FIRST, *FIXED) else F.col(c) for c in old.columns])


def sightings_of(arrivals: DataFrame, start: int = 0) -> DataFrame:
    """Every arrival, repeats too; seq gives the id."""
    return arrivals.select((F.col("seq") + F.lit(start)).alias("id"), "server_id", "source_id", "seen_ts", "remarks")


def apply_pings(servers: DataFrame, pings: DataFrame) -> DataFrame:
    """Every server at a pinged (lower host, port) takes the result and its time."""
    p = pings.select(F.lower("host").alias("__h"), F.col("port").alias("__p"), F.col("ping").alias("__ping"), F.col("ping_ts").alias("__ts")).dropDuplicates(["__h", "__p"])
    out = servers.join(p, (F.lower(servers["host"]) == p["__h"]) & (servers["port"] == p["__p"]), "left")
    return out.select(*[F.coalesce("__ping", "ping").alias(c) if c == "ping" else F.coalesce("__ts", "ping_ts").alias(c) if c == "ping_ts" else F.col(c) for c in servers.columns])


def server_filter(protocols=None, min_first_seen=None, flag_mask: int = 0) -> Column:
    """The conjunction of the optional predicates; hysteria2 and hy2 are one protocol."""
    out = F.lit(True)
    if protocols:
        names = {"hy2" if p.lower() in ("hysteria2", "hysteria", "hy2", "hy") else p.lower() for p in protocols}
        out = out & F.lower("schema").isin(*names)
    if min_first_seen is not None:
        out = out & (F.col("first_seen_ts") >= min_first_seen)
    if flag_mask:
        out = out & (F.col("flags").bitwiseAND(flag_mask) != 0)
    return out


def query_servers(servers: DataFrame, sightings: DataFrame, min_last_seen=None, **filters) -> DataFrame:
    out = servers.where(server_filter(**filters))
    if min_last_seen is not None:
        seen = sightings.where(F.col("seen_ts") >= min_last_seen).select(F.col("server_id").alias("id"))
        out = out.join(seen, "id", "left_semi")
    return out


def in_order(servers: DataFrame) -> DataFrame:
    return servers.orderBy(F.asc("schema"), F.asc_nulls_last("remarks"), "id")


def stale(max_age_cutoff: int) -> Column:
    return (F.col("flags_ts") < max_age_cutoff) | (F.col("flags_ts") == 0)


def latest_per_source(servers: DataFrame, sightings: DataFrame) -> DataFrame:
    """source_id, latest_ts over first-seen times and sightings; null unless above 0."""
    seen = servers.select(F.col("first_seen_source_id").alias("source_id"), F.col("first_seen_ts").alias("ts"))
    every = seen.unionByName(sightings.select("source_id", F.col("seen_ts").alias("ts")))
    return every.groupBy("source_id").agg(F.max("ts").alias("m")).select("source_id", F.when(F.col("m") > 0, F.col("m")).alias("latest_ts"))


def export_lines(servers: DataFrame, sources: DataFrame, link: Column, stamp: str) -> DataFrame:
    """line_no, line of a subscription file: a stamp, the sources in use, a
    blank line, one rebuilt link a server. Numbered by sort keys, not by one
    task; write it sorted by them."""
    used = sources.join(servers.select(F.col("first_seen_source_id").alias("id")).distinct(), "id", "left_semi")
    head = servers.sparkSession.createDataFrame([(0, f"# {stamp}"), (1, "# Sources:"), (3, "")], "part int, line string")
    head = head.select("part", F.lit("").alias("key"), F.lit("").alias("key2"), F.lit(0).cast("long").alias("id"), "line")
    names = used.select(F.lit(2).alias("part"), F.col("url").alias("key"), F.lit("").alias("key2"), "id", F.concat(F.lit("# "), "url").alias("line"))
    body = servers.select(F.lit(4).alias("part"), F.col("schema").alias("key"), F.coalesce("remarks", F.lit("\U0010ffff")).alias("key2"), "id", link.alias("line")).where("line IS NOT NULL")
    return head.unionByName(names).unionByName(body)


def unparseable(parsed: DataFrame) -> DataFrame:
    """Dead letters: what was not parsed or only by a fallback; promotion and private hosts are left out."""
    text = F.when(F.col("parsed_as").isNotNull(), F.concat("error_msg", F.lit(" (parsed as "), "parsed_as", F.lit(")"))).otherwise(F.col("error_msg"))
    rows = parsed.where(F.col("error_class").isNotNull()).withColumn("error", text)
    return rows.where(~F.col("error").contains("promotion") & ~F.col("error").contains("private/reserved host"))


def dead_letters(dead: DataFrame) -> DataFrame:
    """The six fields of the log of links that were not parsed."""
    scheme = F.lower(F.substring_index("raw_url", "://", 1))
    return dead.select("raw_url", scheme.alias("scheme"), "error", stable64(F.col("url")).alias("source_id"), source_type(F.col("url")).alias("source_type"), F.col("seen_ts").alias("timestamp"))


def summary_json(totals: DataFrame) -> DataFrame:
    """One row, summary: the counts of scheme_totals as JSON, schemes in order, the whole under total."""
    one = F.struct(F.col("n_ok").alias("ok"), F.col("n_fail").alias("fail"), F.col("n_total").alias("total"))
    rows = totals.select(F.col("schema").alias("k"), one.alias("v"))  # one row a scheme
    schemes = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))))
    return rows.agg(F.to_json(F.struct(schemes.alias("by_scheme"), F.first(F.when(F.col("k").isNull(), F.col("v")), ignorenulls=True).alias("total"))).alias("summary"))


def ages(servers: DataFrame, now: int) -> DataFrame:
    """Youngest, oldest and mean age in seconds by schema."""
    age = F.lit(now) - F.col("first_seen_ts")
    return servers.groupBy("schema").agg(F.min(age).alias("youngest"), F.max(age).alias("oldest"), F.avg(age).alias("mean"), F.count(F.lit(1)).alias("n"))


def scheme_totals(servers: DataFrame, ok: Column) -> DataFrame:
    """Counts by scheme and in all, in one pass."""
    return servers.rollup("schema").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_fail"), F.count(F.lit(1)).alias("n_total"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered rn."""
    from pyspark.sql import Window

    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= k)


def round_robin(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The distinct rows' first k of each group, dealt in turn: place numbers
    them by rank and then by group. The final order is over k rows a group."""
    from pyspark.sql import Window

    few = top_per_group(df.distinct(), group, order, k)
    return few.withColumn("place", F.row_number().over(Window.orderBy("rn", group)).cast("long"))
