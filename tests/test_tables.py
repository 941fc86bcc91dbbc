"""Tables: upserts, the whole pipeline, sources, streaming, command line."""

from __future__ import annotations

import pytest

from linkloom import cli
from linkloom.operators import ping, store, whitelist
from linkloom.plans.pipeline import Pipeline, recheck
from linkloom.sources import readers
from linkloom.streaming.collect import collect_into, stream_files

LINKS = b"# list\ntrojan://a@h1.example.com:443#one\nnoise ss://YWVzOnB3@h2.example.com:80#two\ntrojan://a@10.0.0.1:443\nwarp://x@y.example.com:1\n"
CASES = {
    "later": ([("s1", 50), ("s1", 100)], (50, "s1")),
    "earlier": ([("s1", 100), ("s2", 50)], (50, "s2")),
    "tie": ([("s1", 100), ("s2", 100)], (100, "s1")),
    "two": ([("s1", 100), ("s2", 200)], (100, "s1")),
}


def arrivals(spark, rows, seq0=0):
    kinds = "seq long, server_id long, source_id long, seen_ts long, remarks string, flags int, flags_ts long, schema string, host string, port string, transport string, security string, raw_config string, sig long"
    data = [(seq0 + i, 1, int(s[1:]), ts, s, 0, ts, "ss", "h", "1", None, None, "{}", 7) for i, (s, ts) in enumerate(rows)]
    return spark.createDataFrame(data, kinds)


@pytest.mark.parametrize("case", sorted(CASES))
@pytest.mark.parametrize("together", [True, False])
def test_upsert(spark, case, together):
    rows, wanted = CASES[case]
    servers = store.empty(spark, store.SERVERS)
    for i, part in enumerate([rows] if together else [[r] for r in rows]):
        servers = store.merge_servers(servers, arrivals(spark, part, i))
    (r,) = servers.collect()
    assert (r.first_seen_ts, f"s{r.first_seen_source_id}") == wanted and r.remarks == wanted[1]


def blobs(spark, data=LINKS, url="https://a.example/x"):
    return spark.createDataFrame([(url, bytearray(data))], "url string, data binary")


def test_pipeline(spark, tmp_path):
    p = Pipeline(spark).add_blobs(blobs(spark), 100).run()
    assert sorted(r.schema for r in p.servers.collect()) == ["ss", "trojan"]
    assert p.sightings.count() == 2 and p.sources.count() == 1
    assert [r.raw_url.split(":")[0] for r in p.dead.collect()] in (["warp"], [])
    p.add_blobs(blobs(spark, url="https://b.example/y"), 50).run()
    assert p.servers.count() == 2 and p.sightings.count() == 4
    assert {r.first_seen_ts for r in p.servers.collect()} == {50}
    lines = [r.line for r in p.export("now").collect()]
    assert lines[0] == "# now" and "trojan://a@h1.example.com:443" in "\n".join(lines)
    p.save(str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/servers")).count() == 2


def test_empty_pipeline(spark):
    p = Pipeline(spark).add_blobs(blobs(spark, b""), 1).run()
    assert p.servers.count() == 0 and Pipeline(spark).run().sightings.count() == 0


def test_recheck(spark):
    p = Pipeline(spark).add_blobs(blobs(spark), 100).run()
    names = whitelist.sni_list(spark.createDataFrame([("H1.example.com",)], "value string"))
    none = spark.createDataFrame([], "value string")
    out = recheck(p.servers, (names, whitelist.ip_list(none), whitelist.cidr_list(none)), 500, 200).collect()
    assert {(r.schema, r.flags, r.flags_ts) for r in out} == {("trojan", 1, 500), ("ss", 0, 500)}
    out = recheck(p.servers, (names, None, None), 500, 200).collect()  # a missing list turns all flags off
    assert {r.flags for r in out} == {0}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(LINKS)
    assert readers.read_source(spark, f"file://{tmp_path}/a.txt").count() == 1

    def fetch(url):
        if "bad" in url:
            raise OSError("down")
        return b"x"

    got = {r.url: (r.data, r.error) for r in readers.read_urls(spark.createDataFrame([("http://ok",), ("http://bad",)], "url string"), fetch).collect()}
    assert got["http://ok"][1] is None and got["http://bad"] == (None, "down")
    with pytest.raises(ValueError):
        readers.read_source(spark, "ftp://x")


def test_streaming(spark, tmp_path):
    """Two runs of a stream, a batch that comes again, and a new driver on the old checkpoint."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(LINKS)
    db, at = str(tmp_path / "db"), str(tmp_path / "q")
    p = Pipeline(spark)
    for _ in range(2):
        collect_into(p, stream_files(spark, str(tmp_path / "in")), at, db).awaitTermination()
        (tmp_path / "in/b.txt").write_bytes(LINKS)
    assert p.servers.count() == 2 and p.sightings.count() == 4
    (tmp_path / "q/commits/1").unlink()  # the driver died after the store's commit, before the stream's
    (tmp_path / "q/commits/.1.crc").unlink(missing_ok=True)
    new = Pipeline(spark)
    collect_into(new, stream_files(spark, str(tmp_path / "in")), at, db).awaitTermination()
    assert new.servers.count() == 2 and new.sightings.count() == 4
    assert store.tags(spark, db) == {f"{at}#0", f"{at}#1"}


def test_channels(spark):
    """Pages are followed to the cut-off; a channel that fails is a row with its error."""
    def fetch(url):
        if "down" in url:
            raise OSError("HTTP status 503")
        if "odd" in url:
            return b'<time datetime="never"></time>'
        n = int(url.partition("before=")[2] or 30)
        return "".join(PAGE.format(i, i, 1 + i // 10) for i in range(max(1, n - 5), n)).encode()

    rows = [("https://t.me/s/good", 1704153600), ("https://t.me/s/down", 1), ("https://t.me/s/odd", 1), ("https://t.me/s/one", None)]
    channels = spark.createDataFrame(rows, "url string, cutoff long")
    pages = readers.channel_pages(channels, fetch).collect()
    assert [r.error for r in pages if "down" in r.url] == ["HTTP status 503"] and sum("odd" in r.url for r in pages) == 1
    got = readers.read_channels(channels, fetch).collect()
    assert sorted(r.msg_id for r in got if "good" in r.url) == list(range(10, 30))
    assert sorted(r.msg_id for r in got if "one" in r.url) == list(range(25, 30))


def test_lists_large_and_small(spark, monkeypatch):
    """Broadcast lists and shuffled ones give the same flags; hosts that are names or null go to no common key."""
    hosts = [("h1.example.com", None), ("1.2.3.4", "H1.example.com"), ("5.6.7.8", None), (None, None), ("9.9.9.9", "x")] * 3
    df = spark.createDataFrame([(i, *h) for i, h in enumerate(hosts)], "k int, host string, sni string")
    val = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    lists = (whitelist.sni_list(val("h1.example.com")), whitelist.ip_list(val("1.2.3.4")), whitelist.cidr_list(val("5.0.0.0/8", "5.6.0.0/16", "1.2.3.0/24")))
    got = []
    for limit in (1 << 25, 0):
        monkeypatch.setattr("linkloom.operators.staging.BROADCAST", limit)
        from pyspark.sql import functions as F

        got.append({r.k: r.flags for r in whitelist.with_flags(df, F.col("host"), F.col("sni"), *lists).collect()})
    assert got[0] == got[1] == {i: (1, 7, 2, 0, 0)[i % 5] for i in range(15)}


def test_lookup_and_misses(spark):
    p = Pipeline(spark).add_blobs(blobs(spark), 100).run()
    (one, *_) = p.servers.collect()
    assert p.lookup(one.id).collect() == [one] and p.lookup(-5).count() == 0 and len(one) == 15
    assert p.parsed == 2 and p.missed.count() == 0


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_bytes(LINKS)
    cli.main(["--db", str(tmp_path / "db"), "local", str(tmp_path / "a.txt")])
    cli.main(["--db", str(tmp_path / "db"), "emit", "--protocol", "trojan"])
    out = capsys.readouterr().out
    assert "trojan://a@h1.example.com:443" in out and "ss://" not in out


def test_ping(spark):
    rows = spark.createDataFrame([("h.example", "1", "tcp"), ("down.example", "1", "udp")], "host string, port string, kind string")

    def probe(host, port, kind):
        if host.startswith("down"):
            raise OSError("refused")
        return 5.0

    got = {r.host: r.status for r in ping.ping(rows, probe).collect()}
    assert got["h.example"].type == "Done" and got["h.example"].latency_ms == 5.0 and got["down.example"].type == "Fail"


def test_probes():
    """TCP, UDP and QUIC against sockets of this machine; a QUIC answer must carry the ids back."""
    import socket
    import threading

    with socket.create_server(("127.0.0.1", 0)) as server:
        assert 0 <= ping.probe_socket("127.0.0.1", server.getsockname()[1], "tcp", 2) < 2000
        port = server.getsockname()[1]
    with pytest.raises(ConnectionRefusedError):
        ping.probe_socket("127.0.0.1", port, "tcp", 2)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as server:
        server.bind(("127.0.0.1", 0))
        port = server.getsockname()[1]

        def answer(right: bool) -> None:
            data, at = server.recvfrom(2048)
            assert len(data) >= 1200 and data[0] & 0x80
            theirs, mine = data[6:14], data[15:23]
            server.sendto(b"\x80" + bytes(4) + b"\x08" + (mine if right else bytes(8)) + b"\x08" + theirs + b"\0\0\0\1", at)

        for right in (True, False):
            t = threading.Thread(target=answer, args=(right,))
            t.start()
            if right:
                assert ping.probe_socket("127.0.0.1", port, "quic", 2) < 2000
            else:
                with pytest.raises(TimeoutError):
                    ping.probe_socket("127.0.0.1", port, "quic", 0.3)
            t.join()
        assert ping.probe_socket("127.0.0.1", port, "udp", 1) < 1000
    texts = [ping.failure(e) for e in (TimeoutError(), ConnectionRefusedError("x"), socket.gaierror("y"), OSError("z"))]
    assert texts == ["connection timed out after 3s", "connection refused: x", "DNS resolution failed: y", "network error: z"]


def test_http(monkeypatch):
    """Statuses, the deadline, and who gets the token, against a server of this machine."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if "no" in self.path else 200)
            self.end_headers()
            for _ in range(20 if "slow" in self.path else 1):
                self.wfile.write(b"body")
                self.wfile.flush()
                time.sleep(0.1 if "slow" in self.path else 0)

        def log_message(self, *args):
            pass

    monkeypatch.delenv("HTTP_PROXY", raising=False)
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert readers.http_fetch(f"{at}/x") == readers.http_fetch(f"{at}/no") == b"body"
    with pytest.raises(readers.HttpStatus, match="404"):
        readers.http_fetch(f"{at}/no", strict=True)
    with pytest.raises(TimeoutError):
        readers.http_fetch(f"{at}/slow", retries=0, deadline=0.3)
    seen = []

    class Opener:
        def open(self, request, timeout):
            seen.append((request.host, request.headers.get("Authorization")))
            raise readers.HttpStatus("stop")

    monkeypatch.setattr(readers, "_opener", Opener)
    monkeypatch.setenv("GITHUB_TOKEN", "t")
    for url in ("https://github.com/a", "https://raw.githubusercontent.com/a", "https://github.com.example/a"):
        with pytest.raises(OSError):
            readers.http_fetch(url, retries=0)
    assert seen == [("github.com", "Bearer t"), ("raw.githubusercontent.com", "Bearer t"), ("github.com.example", None)]
    monkeypatch.undo()
    monkeypatch.setenv("HTTP_PROXY", at)
    assert readers.http_fetch("http://elsewhere.example/x") == b"body"
    server.shutdown()


PAGE = """<div class="tgme_widget_message" data-post="chan/{}"><a class="tgme_widget_message_owner_name" href="https://t.me/chan">c</a>
<div class="tgme_widget_message_text">trojan://a@h{}.example.com:443#m</div><time datetime="2024-01-0{}T00:00:00+00:00"></time></div>"""


def test_cli_store(spark, tmp_path, capsys):
    """Collecting again adds to the store; channels, the log, lists, probes and pulls."""
    db, log = ["--db", str(tmp_path / "db")], ["--unparseable-log", str(tmp_path / "log")]
    (tmp_path / "a.txt").write_bytes(LINKS)
    (tmp_path / "c.yaml").write_text("tgchannel: ['@chan']\nsubscriptions: ['https://s.example/x']\n")
    asked = []

    def fetch(url):
        asked.append(url)
        if "t.me" in url:
            return PAGE.format(1, 7, 5).encode()
        return b"ss://YWVzOnB3@h9.example.com:80#nine\n"

    cli.main([*db, *log, "local", str(tmp_path / "a.txt")])
    cli.main([*db, "local", str(tmp_path / "a.txt")])
    p = Pipeline.load(spark, str(tmp_path / "db"))
    assert (p.servers.count(), p.sightings.count(), p.sources.count()) == (2, 4, 1)
    assert len({r.id for r in p.sightings.collect()}) == 4
    got = [(r.scheme, r.source_type) for r in spark.read.json(str(tmp_path / "log")).collect()]
    assert got == [("warp", "other")] or got == []

    cli.main([*db, "config", str(tmp_path / "c.yaml"), "--last", "9000d"], fetch=fetch)
    p = Pipeline.load(spark, str(tmp_path / "db"))
    assert {r.host for r in p.servers.collect()} == {f"h{i}.example.com" for i in (1, 2, 7, 9)}
    assert p.servers.where("host = 'h7.example.com'").first().first_seen_ts == 1704412800

    cli.main([*db, "emit", "--pull", "sub"], fetch=fetch)
    assert Pipeline.load(spark, str(tmp_path / "db")).sightings.count() == 9

    for name, text in (("sni", "H1.example.com"), ("ip", "1.2.3.4"), ("cidr", "10.0.0.0/8")):
        (tmp_path / name).write_text(text)
    lists = [x for n in ("sni", "ip", "cidr") for x in (f"--whitelist-{n}", str(tmp_path / n))]
    capsys.readouterr()
    cli.main([*db, *lists, "emit", "--recheck-whitelist", "--wl", "1"])
    out = capsys.readouterr().out
    assert "h1.example.com" in out and "h2.example.com" not in out


def test_cli_ping(spark, tmp_path, capsys):
    db = ["--db", str(tmp_path / "db")]
    (tmp_path / "a.txt").write_bytes(LINKS)

    def probe(host, port, kind):
        if host.startswith("h2"):
            raise OSError("refused")
        return 5.0

    cli.main([*db, "local", str(tmp_path / "a.txt")])
    cli.main([*db, "ping"], probe=probe)
    out = capsys.readouterr().out
    assert "h1.example.com:443 ok 5.0ms" in out and "1 ok, 1 fail, 2 total" in out
    cli.main([*db, "emit", "--ping", "ok"], probe=probe)
    out = capsys.readouterr().out
    assert "h1.example.com" in out and "h2.example.com" not in out
    assert Pipeline.load(spark, str(tmp_path / "db")).servers.where("ping IS NOT NULL AND ping_ts > 0").count() == 2
