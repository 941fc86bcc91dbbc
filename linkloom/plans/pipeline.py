"""Collecting: blobs to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable64
from ..operators import records, store, whitelist
from ..operators.extract import extract_links
from ..operators.staging import bounded, stage


def arrivals_of(links: DataFrame, lists: tuple | None = None, start: int = 0, fallback: bool = True) -> tuple[DataFrame, DataFrame]:
    """(arrivals, dead letters) of links: raw_url, url, seen_ts and the order
    columns batch, pos. Links are parsed once, into a table that all later
    steps read. seq numbers arrivals in the order of batch and pos: a download
    begins where the one before ends, its places are offsets, so no download
    is sorted in one task; the only window is over one row a download."""
    parsed = stage(records.parse_links(links, fallback=fallback))
    c = F.col("cfg")
    good = parsed.where("cfg IS NOT NULL")
    flagged = whitelist.with_flags(good, c["host"], c["sni"], *(lists or (None, None, None)))
    sizes = parsed.groupBy("batch").agg(F.max("pos").alias("n"))
    offsets = sizes.withColumn("base", F.coalesce(F.sum(F.col("n") + 1).over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = stage(offsets.select("batch", "base"))
    few = bounded(offsets, 128)
    rows = flagged.join(offsets if few is None else few, "batch")
    arrivals = rows.select(
        (F.col("base") + F.col("pos") + 1 + start).cast("long").alias("seq"), stable64(F.col("url")).alias("source_id"), F.col("seen_ts"), records.uid(c).alias("server_id"),
        records.sig(c).alias("sig"), F.coalesce(c["remarks"], F.lit(None)).alias("remarks"), F.col("flags"), F.col("seen_ts").alias("flags_ts"), c["schema"].alias("schema"),
        F.coalesce(c["host"], F.lit("")).alias("host"), F.coalesce(c["port"], F.lit("")).alias("port"), c["transport"].alias("transport"), c["security"].alias("security"),
        records.raw_config(c).alias("raw_config"),
    )
    return arrivals, store.unparseable(parsed)


class Pipeline:
    """Sources in, tables out: add_blobs() or add_links(), then run()."""

    def __init__(self, spark: SparkSession, lists: tuple | None = None):
        self.spark, self.lists = spark, lists
        self.sources, self.servers, self.sightings = (store.empty(spark, s) for s in (store.SOURCES, store.SERVERS, store.SIGHTINGS))
        self.fresh = self.sightings
        self.pending: list[DataFrame] = []
        self.dead: DataFrame | None = None
        self.missed: DataFrame | None = None
        self.parsed = 0

    def add_blobs(self, blobs: DataFrame, seen_ts: int) -> Pipeline:
        """blobs: url, data; a url may come twice."""
        rows = blobs.where("data IS NOT NULL").select("url", "data").withColumn("part", F.monotonically_increasing_id())
        return self.add_links(extract_links(rows).withColumn("seen_ts", F.lit(seen_ts).cast("long")))

    def add_links(self, links: DataFrame) -> Pipeline:
        """links: url, raw_url, pos, seen_ts, and part if (url, pos) alone doesn't tell links apart."""
        part = F.format_string("-%d", "part") if "part" in links.columns else F.lit("")
        self.pending.append(links.withColumn("batch", F.concat(F.lit(f"{len(self.pending):08d}-"), "url", part)).select("url", "raw_url", "pos", "seen_ts", "batch"))
        return self

    def add_messages(self, messages: DataFrame) -> Pipeline:
        """messages: url, msg_id, ts, raw_urls; each message is seen at its own time."""
        rows = messages.select("url", F.col("ts").alias("seen_ts"), "msg_id", F.posexplode("raw_urls").alias("at", "raw_url"))
        return self.add_links(rows.withColumn("pos", F.col("msg_id") * 4096 + F.col("at")))

    def lookup(self, server_id: int) -> DataFrame:
        """The server of an id: one row or none, found by a pushed-down filter."""
        return store.get_server(self.servers, server_id)

    def run(self) -> Pipeline:
        """Merges what was added. missed holds the arrivals whose source is not
        registered; parsed the number of links read."""
        from functools import reduce

        if not self.pending:
            return self
        links = reduce(DataFrame.unionByName, self.pending)
        self.pending = []
        self.sources = store.upsert_sources(self.sources, links)
        start = self.sightings.agg(F.max("id")).first()[0] or 0
        arrivals, self.dead = arrivals_of(links, self.lists, start)
        self.missed = store.fk_violations(arrivals, self.sources, "source_id")
        self.parsed = arrivals.count()
        self.servers = store.merge_servers(self.servers, arrivals)
        new = store.sightings_of(arrivals)
        self.sightings, self.fresh = self.sightings.unionByName(new), self.fresh.unionByName(new)
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str, lists: tuple | None = None) -> Pipeline:
        """The tables that commits left under path; none yet: empty ones."""
        p = cls(spark, lists)
        done = store.versions(spark, path)
        if done:
            p.sources, p.servers = (spark.read.parquet(f"{path}/{done[-1]}/{n}") for n in ("sources", "servers"))
            p.sightings = spark.read.schema(store.SIGHTINGS).parquet(*[f"{path}/{v}/sightings" for v in done])
        return p

    def commit(self, path: str, tag: str | None = None) -> None:
        """Adds a version: only sightings since the last commit are written, and
        servers come last, so a version cut short is never read. tag names the
        micro-batch it holds, for store.tags()."""
        done = store.versions(self.spark, path)
        at = f"{path}/v{int(done[-1][1:]) + 1 if done else 0:012d}"
        if tag:
            self.spark.createDataFrame([(tag,)], "tag string").write.mode("overwrite").parquet(f"{at}/tag")
        for name, table in (("sources", self.sources), ("sightings", self.fresh), ("servers", self.servers)):
            table.write.mode("overwrite").parquet(f"{at}/{name}")
        self.fresh = store.empty(self.spark, store.SIGHTINGS)

    def save(self, path: str) -> None:
        """Parquet tables in a new folder; swap it in when whole."""
        for name in ("sources", "servers", "sightings"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    def export(self, stamp: str) -> DataFrame:
        link = records.rebuild(records.from_config(F.col("raw_config")))
        return store.export_lines(self.servers, self.sources, link, stamp).orderBy("part", "key", "key2", "id").select("line")


def recheck(servers: DataFrame, lists: tuple, now: int, cutoff: int) -> DataFrame:
    """servers with the flags of stale rows computed again from raw_config."""
    c = records.from_config(F.col("raw_config"))
    old = servers.where(store.stale(cutoff) & c["schema"].isNotNull())
    new = whitelist.with_flags(old.drop("flags"), c["host"], c["sni"], *lists).withColumn("flags_ts", F.lit(now).cast("long"))
    rest = servers.where(~(store.stale(cutoff) & c["schema"].isNotNull()))
    return rest.unionByName(new.select(*servers.columns))
