"""Command line: collect, collect again, probe, emit links."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import duration_seconds
from .operators import ping, records, store, whitelist
from .operators.staging import drop_staged, stage
from .plans.pipeline import Pipeline, recheck
from .sources import readers

LISTS = ("sni", "ip", "cidr")


def _filters(p: argparse.ArgumentParser) -> None:
    p.add_argument("--protocol", action="append")
    p.add_argument("--min-first-seen")
    p.add_argument("--min-last-seen")
    p.add_argument("--wl", type=int, default=0)
    p.add_argument("--recheck-whitelist", action="store_true")
    p.add_argument("--recheck-max-age", default="0s")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkloom")
    p.add_argument("--db", default="linkloom-db")
    p.add_argument("--unparseable-log")
    for name in LISTS:
        p.add_argument(f"--whitelist-{name}")
    sub = p.add_subparsers(dest="command")
    for name, arg in (("local", "paths"), ("remote", "urls"), ("stdin", None), ("config", "file")):
        s = sub.add_parser(name)
        if arg:
            s.add_argument(arg, nargs=None if name == "config" else "+")
        if name == "config":
            until = s.add_mutually_exclusive_group()
            until.add_argument("--last", help="channel messages of this duration")
            until.add_argument("--upto", help="channel messages since this time (RFC 3339)")
        s.add_argument("--emit", action="store_true")
        s.add_argument("--ping")
        _filters(s)
    e = sub.add_parser("emit")
    e.add_argument("--pull", choices=("sub", "tg", "all"))
    e.add_argument("--ping", help="only servers that answer: ok, or within a duration")
    _filters(e)
    _filters(sub.add_parser("ping"))
    return p


def _utc(text: str) -> datetime:
    """A time without a zone is in UTC."""
    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def _lists(spark: SparkSession, a: argparse.Namespace) -> tuple | None:
    """The three allow-lists, or None if any is missing."""
    files = [getattr(a, f"whitelist_{n}") for n in LISTS]
    if not all(files):
        return None
    return tuple(f(spark.read.text(p)) for f, p in zip((whitelist.sni_list, whitelist.ip_list, whitelist.cidr_list), files, strict=True))


def _known(p: Pipeline, scope: str) -> DataFrame:
    """url, type, cutoff of the stored sources that can be read again; a channel
    goes on from the newest thing seen there, and one never seen is left out."""
    seen = store.latest_per_source(p.servers, p.sightings).withColumnRenamed("source_id", "id")
    rows = p.sources.where(F.col("url").rlike("^(https?|file):")).withColumn("type", store.source_type(F.col("url"))).join(seen, "id", "left")
    rows = rows.where((F.col("type") != "telegram") | F.col("latest_ts").isNotNull())
    wanted = {"sub": F.col("type") != "telegram", "tg": F.col("type") == "telegram", "all": F.lit(True)}[scope]
    return rows.where(wanted).select("url", "type", F.col("latest_ts").alias("cutoff"))


def _add(p: Pipeline, listed: DataFrame, a: argparse.Namespace, now: int, fetch: readers.Fetch) -> Pipeline:
    """listed: url, type, cutoff."""
    web = listed.where((F.col("type") != "telegram") & F.col("url").rlike("^https?:"))
    p.add_blobs(stage(readers.read_urls(web, fetch), a.db), now)
    files = [r.url for r in listed.where(F.col("url").startswith("file:")).select("url").toLocalIterator()]
    if files:
        p.add_blobs(readers.read_files(p.spark, *files), now)
    channels = listed.where("type = 'telegram'")
    pages = stage(readers.channel_pages(channels, None if fetch is readers.http_fetch else fetch), a.db)
    for r in pages.where("error IS NOT NULL").select("url", "error").toLocalIterator():
        print(f"{r.url}: {r.error}", file=sys.stderr)
    return p.add_messages(readers.channel_messages(pages, channels))


def _finish(p: Pipeline, a: argparse.Namespace) -> Pipeline:
    p.run().commit(a.db)
    if a.unparseable_log and p.dead is not None:
        store.dead_letters(p.dead).write.mode("append").json(a.unparseable_log)
    return Pipeline.load(p.spark, a.db, p.lists)


def _selected(p: Pipeline, a: argparse.Namespace, now: int) -> DataFrame:
    ago = lambda d: None if d is None else max(0, now - duration_seconds(d))
    if a.recheck_whitelist and p.lists:
        p.servers = recheck(p.servers, p.lists, now, now - duration_seconds(a.recheck_max_age))
        p.commit(a.db)
    return store.query_servers(p.servers, p.sightings, ago(a.min_last_seen), protocols=a.protocol, min_first_seen=ago(a.min_first_seen), flag_mask=a.wl)


def _probe(p: Pipeline, rows: DataFrame, a: argparse.Namespace, now: int, probe: Callable) -> DataFrame:
    """Probes the endpoints of rows and stores the results with their servers."""
    results = stage(ping.ping(ping.endpoints(rows), probe), a.db)
    p.servers = store.apply_pings(p.servers, results.select("host", "port", ping.ping_json(F.col("kind"), F.col("status")).alias("ping"), F.lit(now).cast("long").alias("ping_ts")))
    p.commit(a.db)
    return results


def _emit(p: Pipeline, a: argparse.Namespace, now: int, probe: Callable) -> None:
    rows = _selected(p, a, now)
    if a.ping:
        rows = ping.reachable(rows, _probe(p, rows, a, now, probe), ping.threshold(a.ping))
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now))
    lines = store.export_lines(rows, p.sources, records.rebuild(records.from_config(F.col("raw_config"))), stamp)
    for r in lines.orderBy("part", "key", "key2", "id").select("line").toLocalIterator():
        print(r[0])


def main(args: list[str] | None = None, fetch: readers.Fetch = readers.http_fetch, probe: Callable = ping.probe_socket) -> None:
    """Without a command every known source is read again."""
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("linkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        _main(spark, a, fetch, probe)
    finally:
        drop_staged(spark)


def _main(spark: SparkSession, a: argparse.Namespace, fetch: readers.Fetch, probe: Callable) -> None:
    now = int(time.time())
    p = Pipeline.load(spark, a.db, _lists(spark, a))
    if a.command == "ping":
        results = _probe(p, _selected(p, a, now), a, now, probe)
        for r in ping.result_lines(results).toLocalIterator():
            print(r[0])
        ok, n = results.agg(F.count_if(F.col("status.type") == "Done"), F.count(F.lit(1))).first()
        print(f"{ok} ok, {n - ok} fail, {n} total")
        return
    if a.command == "emit":
        if a.pull:
            p = _finish(_add(p, _known(p, a.pull), a, now, fetch), a)
    elif a.command == "local":
        p = _finish(p.add_blobs(readers.read_files(spark, *a.paths), now), a)
    elif a.command == "stdin":
        p = _finish(p.add_blobs(readers.read_stdin(spark), now), a)
    elif a.command == "config":
        with open(a.file, encoding="utf-8") as f:
            listed = readers.read_config(spark, f.read())
        cutoff = now - duration_seconds(a.last) if a.last else int(_utc(a.upto).timestamp()) if a.upto else None
        p = _finish(_add(p, listed.withColumn("cutoff", F.lit(cutoff).cast("long")), a, now, fetch), a)
    elif a.command == "remote":
        listed = spark.createDataFrame([(u,) for u in a.urls], "url string").select("url", store.source_type(F.col("url")).alias("type"), F.lit(None).cast("long").alias("cutoff"))
        p = _finish(_add(p, listed, a, now, fetch), a)
    else:
        _finish(_add(p, _known(p, "all"), a, now, fetch), a)
    if a.command and (a.command == "emit" or a.emit):
        _emit(p, a, now, probe)


if __name__ == "__main__":
    main()
