"""Sources of link text; the transport is an argument, so tests need no network."""

from __future__ import annotations

import os
import re
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from urllib.parse import quote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import channel_url
from ..operators.extract import page_messages

Fetch = Callable[[str], bytes]
#: Hosts that get the token, and those of a proxy that is used (fixed values).
TOKEN_HOSTS, PROXY_HOSTS = ("github.com", "raw.githubusercontent.com"), ("127.0.0.1", "localhost")


class HttpStatus(OSError):
    """An answer with a status of 400 or more."""


def _opener() -> urllib.request.OpenerDirector:
    """With HTTP_PROXY if it names this machine, with its user and password, else with none."""
    proxy = urlparse(os.environ.get("HTTP_PROXY", ""))
    if proxy.scheme not in ("http", "https") or proxy.hostname not in PROXY_HOSTS:
        return urllib.request.build_opener(urllib.request.ProxyHandler({}))
    user, word = os.environ.get("HTTP_PROXY_USERNAME"), os.environ.get("HTTP_PROXY_PASSWORD")
    at = f"{quote(user, safe='')}:{quote(word, safe='')}@" if user and word else ""
    place = f"{proxy.scheme}://{at}{proxy.netloc.rpartition('@')[2]}"
    return urllib.request.build_opener(urllib.request.ProxyHandler({"http": place, "https": place}))


def http_fetch(url: str, retries: int = 3, timeout: float = 30.0, token: str | None = None, deadline: float = 90.0, strict: bool = False) -> bytes:
    """A body whatever its status, or HttpStatus if strict; connection errors
    are tried again. A body that isn't whole after ``deadline`` seconds is a
    TimeoutError. token: by default GITHUB_TOKEN, for TOKEN_HOSTS alone."""
    token = token or os.environ.get("GITHUB_TOKEN")
    headers = {"Authorization": f"Bearer {token}"} if token and urlparse(url).hostname in TOKEN_HOSTS else {}
    ends = time.monotonic() + deadline
    for left in range(retries, -1, -1):
        try:
            with _opener().open(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                parts = []
                while part := r.read(1 << 16):
                    parts.append(part)
                    if time.monotonic() > ends:
                        raise TimeoutError(f"no whole answer in {deadline:g} s")
                return b"".join(parts)
        except urllib.error.HTTPError as e:
            if strict:
                raise HttpStatus(f"HTTP status {e.code}") from None
            return e.read()
        except OSError:
            if not left or time.monotonic() > ends:
                raise
            time.sleep(1)
    raise AssertionError


def read_stdin(spark: SparkSession, stream=None) -> DataFrame:
    data = (stream or sys.stdin.buffer).read()
    if not data:
        raise ValueError("stdin is empty")
    return spark.createDataFrame([("stdin://local", bytearray(data))], "url string, data binary")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("url"), F.col("content").alias("data"))


def read_urls(urls: DataFrame, fetch: Fetch = http_fetch, url: str = "url", at_once: int = 8) -> DataFrame:
    """url, data, error: one download a row, ``at_once`` at a time in each task that holds the urls."""

    def one(u: str) -> tuple:
        try:
            return u, fetch(u), None
        except Exception as e:  # noqa: BLE001  an unreachable source is a row with its error
            return u, None, str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                for i in range(0, len(b), at_once):
                    yield pd.DataFrame(list(pool.map(one, b[url][i : i + at_once])), columns=["url", "data", "error"])

    return urls.select(url).mapInPandas(run, "url string, data binary, error string")


def read_source(spark: SparkSession, url: str, fetch: Fetch = http_fetch) -> DataFrame:
    """The reader that a url's scheme asks for."""
    scheme = urlparse(url).scheme
    if scheme == "stdin":
        return read_stdin(spark)
    if scheme in ("http", "https"):
        return read_urls(spark.createDataFrame([(url,)], "url string"), fetch).select("url", "data")
    if scheme == "file":
        return read_files(spark, url)
    raise ValueError(f"unsupported scheme: {scheme}")


def _time(text: str) -> float:
    try:
        return pd.Timestamp(text).timestamp()
    except ValueError:
        return float("nan")


def page_bounds(html: str) -> tuple[int | None, float | None]:
    """(the first message's number, the oldest message's time) of a channel page."""
    ids = [int(x) for x in re.findall(r'data-post="[^"]*/([0-9]+)"', html)]
    times = [t for x in re.findall(r'<time[^>]*datetime="([^"]+)"', html) if (t := _time(x)) == t]
    return min(ids, default=None), min(times, default=None)


def channel_pages(channels: DataFrame, fetch: Fetch | None = None, at_once: int = 8) -> DataFrame:
    """url, html, error of the pages of public channels (url, cutoff): pages are
    followed backwards while a cut-off is set and no older message was seen.
    ``at_once`` channels of a task are read at a time, a page of each; a page
    that fails, for its status too, is a row with its error and ends its channel."""
    fetch = fetch or partial(http_fetch, strict=True)

    def step(state: tuple) -> tuple:
        url, cutoff, at = state
        try:
            html = fetch(url if at is None else f"{url}?before={at}").decode("utf-8", "replace")
        except Exception as e:  # noqa: BLE001
            return (url, None, str(e) or type(e).__name__), None
        first, oldest = page_bounds(html)
        done = pd.isna(cutoff) or first is None or first < 2 or oldest is None or oldest < cutoff or (at is not None and first >= at)
        return (url, html, None), None if done else (url, cutoff, first)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                todo = [(u, c, None) for u, c in zip(b["url"], b["cutoff"], strict=True)]
                while todo:
                    now, todo = todo[:at_once], todo[at_once:]
                    got = list(pool.map(step, now))
                    todo = [more for _, more in got if more] + todo
                    yield pd.DataFrame([row for row, _ in got], columns=["url", "html", "error"])

    return channels.select("url", F.col("cutoff").cast("double").alias("cutoff")).mapInPandas(run, "url string, html string, error string")


def channel_messages(pages: DataFrame, channels: DataFrame) -> DataFrame:
    """The messages of pages (url, html); those before their channel's cut-off are dropped."""
    messages = page_messages(pages.where("html IS NOT NULL").select("url", "html")).dropDuplicates(["url", "msg_id"])
    limits = channels.select("url", "cutoff").dropDuplicates(["url"])
    return messages.join(limits, "url").where(F.col("cutoff").isNull() | (F.col("ts") >= F.col("cutoff"))).drop("cutoff")


def read_channels(channels: DataFrame, fetch: Fetch | None = None) -> DataFrame:
    """Messages of public channels (url, cutoff)."""
    return channel_messages(channel_pages(channels, fetch), channels)


def read_config(spark: SparkSession, text: str) -> DataFrame:
    """url, type of the lists tgchannel and subscriptions of a YAML mapping."""
    import yaml

    conf = yaml.safe_load(text)
    if not isinstance(conf, dict):
        raise ValueError("the configuration must be a mapping")
    rows = [(u, t) for k, t in (("tgchannel", "telegram"), ("subscriptions", "subscription")) for u in conf.get(k) or [] if isinstance(u, str)]
    df = spark.createDataFrame(rows, "url string, type string")
    return df.withColumn("url", F.when(F.col("type") == "telegram", channel_url(F.col("url"))).otherwise(F.col("url")))
