"""Reachability of servers, with the prober as an argument."""

from __future__ import annotations

import os
import socket
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import duration_seconds, u16

QUIC, UDP = ("tuic", "hy2", "hysteria2"), ("wireguard", "stormdns", "slipnet")


def kind_of(schema: Column) -> Column:
    return F.when(schema.isin(*QUIC), "quic").when(schema.isin(*UDP), "udp").otherwise("tcp")


def pingable(port: Column) -> Column:
    return F.coalesce(u16(port) > 0, F.lit(False))


def endpoints(servers: DataFrame) -> DataFrame:
    """Distinct (lower host, port) with the method of the first server in id order."""
    rows = servers.where(pingable(F.col("port")) & (F.col("host") != "")).select(F.lower("host").alias("host"), "port", kind_of(F.col("schema")).alias("kind"), "id")
    return rows.groupBy("host", "port").agg(F.min_by("kind", "id").alias("kind"))


#: A QUIC version that no server has (RFC 9000, 15: reserved to force negotiation), and the least size of a first packet.
NO_VERSION, FIRST_PACKET = 0x1A2A3A4A, 1200


def _udp(host: str, port: int, timeout: float) -> socket.socket:
    kind, _, _, _, address = socket.getaddrinfo(host, port, type=socket.SOCK_DGRAM)[0]
    s = socket.socket(kind, socket.SOCK_DGRAM)
    s.settimeout(timeout)
    s.connect(address)
    return s


def _probe_quic(host: str, port: int, timeout: float) -> None:
    """Asks for a version that doesn't exist: every QUIC server answers with
    those it has (version negotiation), before any cryptography. The answer
    must carry both connection ids back."""
    mine, theirs = os.urandom(8), os.urandom(8)
    first = bytes([0xC0]) + NO_VERSION.to_bytes(4, "big") + b"\x08" + theirs + b"\x08" + mine
    wanted = b"\0\0\0\0\x08" + mine + b"\x08" + theirs
    ends = time.monotonic() + timeout
    with _udp(host, port, timeout) as s:
        s.send(first.ljust(FIRST_PACKET, b"\0"))
        while (left := ends - time.monotonic()) > 0:
            s.settimeout(left)
            got = s.recv(2048)
            if got[:1] and got[0] & 0x80 and got[1:].startswith(wanted):
                return
    raise TimeoutError


def probe_socket(host: str, port: int, kind: str, timeout: float = 3.0) -> float:
    """Milliseconds to connect (TCP), to get a QUIC server's versions, or to send one byte (UDP); raises OSError."""
    began = time.monotonic()
    if kind == "quic":
        _probe_quic(host, port, timeout)
    elif kind == "tcp":
        socket.create_connection((host, port), timeout).close()
    else:
        with _udp(host, port, timeout) as s:
            s.send(b"\0")
    return (time.monotonic() - began) * 1000


def ping(targets: DataFrame, probe: Callable[[str, int, str], float] = probe_socket, in_flight: int = 200) -> DataFrame:
    """host, port, kind, status struct<type, latency_ms, error> of each endpoint."""

    def one(host: str, port: str, kind: str):
        try:
            return "Done", float(probe(host, int(port), kind)), None
        except Exception as e:  # noqa: BLE001  an endpoint that can't be probed is a row with its error
            return "Fail", None, failure(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                got = list(pool.map(one, b["host"], b["port"], b["kind"]))
                yield b.assign(type=[g[0] for g in got], latency_ms=[g[1] for g in got], error=[g[2] for g in got])

    out = targets.select("host", "port", "kind").mapInPandas(run, "host string, port string, kind string, type string, latency_ms double, error string")
    return out.select("host", "port", "kind", F.struct("type", "latency_ms", "error").alias("status"))


def ping_json(kind: Column, status: Column) -> Column:
    return F.to_json(F.struct(kind.alias("kind"), status.alias("status")))


def within(status: Column, threshold_ms: float | None) -> Column:
    ok = status["type"] == "Done"
    return ok if threshold_ms is None else ok & (status["latency_ms"] <= threshold_ms)


def threshold(spec: str) -> float | None:
    """ok, or a duration, as milliseconds."""
    return None if spec == "ok" else (float(spec[:-2]) if spec.endswith("ms") else duration_seconds(spec) * 1000.0)


def reachable(servers: DataFrame, results: DataFrame, threshold_ms: float | None = None) -> DataFrame:
    good = results.where(within(F.col("status"), threshold_ms)).select(F.lower("host").alias("__h"), F.col("port").alias("__p"))
    return servers.join(good, (F.lower(servers["host"]) == good["__h"]) & (servers["port"] == good["__p"]), "left_semi")


def with_results(servers: DataFrame, results: DataFrame) -> DataFrame:
    """servers that have a usable port and a result for their endpoint, with its status."""
    got = results.select(F.lower("host").alias("__h"), F.col("port").alias("__p"), "status").dropDuplicates(["__h", "__p"])
    rows = servers.where(pingable(F.col("port")))
    return rows.join(got, (F.lower(rows["host"]) == got["__h"]) & (rows["port"] == got["__p"])).drop("__h", "__p")


def failure(e: Exception, timeout: float = 3.0) -> str:
    """The text of a failed probe by its class: timeout, refused, name or network."""
    if isinstance(e, TimeoutError):
        return f"connection timed out after {timeout:g}s"
    if isinstance(e, ConnectionRefusedError):
        return f"connection refused: {e}"
    if isinstance(e, (socket.gaierror, FileNotFoundError, UnicodeError)):
        return f"DNS resolution failed: {e}"
    return f"network error: {e}" if str(e) else f"network error: {type(e).__name__}"


def result_lines(results: DataFrame) -> DataFrame:
    s = F.col("status")
    ok = F.concat(F.lit(" ok "), F.format_string("%.1f", s["latency_ms"]), F.lit("ms"))
    text = F.when(s["type"] == "Done", ok).otherwise(F.concat(F.lit(" fail "), F.coalesce(s["error"], F.lit(""))))
    return results.select(F.concat("host", F.lit(":"), "port", text).alias("line"))


__all__ = ["endpoints", "failure", "kind_of", "ping", "ping_json", "pingable", "probe_socket", "reachable", "result_lines", "threshold", "with_results", "within"]
