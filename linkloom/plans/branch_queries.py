"""Queries that take single branches of the operators: odd links, lists, pages and
results, each with SQL that states the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import loose_json
from ..functions import scalars as S
from ..operators import extract, ping, records, store, whitelist
from ..operators.uri import split_uri
from ..sources import readers
from . import testlinks as L
from .pipeline import Pipeline, recheck
from .queries import CUST, EARLY, EV, HOSTS, IP_SQL, MIXED, MSG, NET_SQL, SNI_SQL, SRV, STABLE, _cut, _results, _servers, customers, events, linked, lists, mixed, placed, query


def text(v) -> str:
    """v as a SQL literal; {k} in it is the row's key."""
    if v is None:
        return "NULL"
    quoted = "'" + str(v).replace("'", "''") + "'"
    return f"replace({quoted}, '{{k}}', k::VARCHAR)" if "{k}" in str(v) else quoted


def chosen(cases: list, value=lambda c: c) -> str:
    """SQL: the value of case k modulo their number."""
    return f"CASE k % {len(cases)} " + " ".join(f"WHEN {i} THEN {text(value(c))}" for i, c in enumerate(cases)) + " END"


def given(spark: SparkSession, d: str, cases: list[str]) -> DataFrame:
    """k and raw: the case of k modulo their number. {k} in it is k, {ip6} is k as the last groups of an IPv6 address."""
    raw = F.element_at(F.array(*[F.lit(c) for c in cases]), (F.col("k") % len(cases) + 1).cast("int"))
    groups = F.regexp_replace(F.hex("k"), "(?!^)(?=(.{4})+$)", ":")  # of four digits at most
    return customers(spark, d).select("k", "name", F.replace(F.replace(raw, F.lit("{k}"), F.col("k").cast("string")), F.lit("{ip6}"), groups).alias("raw"))


def cases(name: str, rows: list[tuple], outcomes: tuple[str, ...]):
    """A query over links (first of each row) whose columns are the rest of the row."""
    sql = "SELECT k, " + ", ".join(f"{chosen(rows, lambda c, i=i: c[i + 1])} AS {o}" for i, o in enumerate(outcomes)) + f" FROM {CUST}"

    def add(f):
        query(name, sql)(lambda spark, d: f(given(spark, d, [r[0] for r in rows])).select("k", *outcomes))
        return f

    return add


A = "@h{k}.example.com:443"
ID = "0a0a0a0a-1111-4222-8333-00000000000b"


def parsed(links: DataFrame, fallback: bool = False) -> DataFrame:
    return records.parse_links(links.withColumnRenamed("raw", "raw_url"), fallback=fallback)


@cases("transport_resolve", [
    (f"vless://{ID}{A}?type={t}&host=f.example&path=%2Fp", found, None if found else "InvalidConf", "/p" if found else None, "f.example" if found in ("httpupgrade", "xhttp") else None)
    for t, found in (("ws", "ws"), ("WebSocket", "ws"), ("grpc", "grpc"), ("gRPC-multi", "grpc"), ("h2", "http"), ("HTTPS", "http"), ("http", "http"), ("httpupgrade", "httpupgrade"), ("splithttp", "xhttp"),
                     ("xhttp", "xhttp"), ("mkcp", "kcp"), ("kcp", "kcp"), ("quic", "quic"), ("raw", "tcp"), ("tcp", "tcp"), ("auto", "tcp"), ("none", "tcp"), ("", "tcp"), ("wsx", "ws"), ("odd", None))
], ("transport", "error_class", "path", "transport_host"))
def transport_resolve(links):
    return parsed(links).select("k", "cfg.transport", "error_class", "cfg.path", "cfg.transport_host")


@cases("transport_defaults", [
    (f"vless://{ID}{A}?type=xhttp", "/", "h{k}.example.com", "auto"), (f"vless://{ID}{A}?type=httpupgrade&sni=s.example", "/", None, None), (f"vless://{ID}{A}?type=xhttp&security=tls&sni=s.example&mode=packet-up-1", "/", "s.example", "packet-up"),
    (f"vless://{ID}{A}?type=ws", None, None, None), (f"vless://{ID}{A}", None, None, None),
], ("path", "transport_host", "transport_mode"))
def transport_defaults(links):
    c = parsed(links).select("k", "cfg.*")
    return c.select("k", "path", F.when((F.col("k") % 5) != 1, F.col("transport_host")).alias("transport_host"), "transport_mode")


NONE = (None,) * 6


def b64(s: str) -> str:
    import base64

    return base64.b64encode(s.encode()).decode()


@cases("parse_shapes", [
    (f"vless://{ID}@[2001:4860::{{ip6}}]:8443?type=grpc&security=reality&sni=a.example&pbk=KEY&sid=0f&fp=chrome&flow=xtls#n", "vless", None, "8443", "grpc", "reality", "KEY"),
    (f"vless://plain-name{A}?security=none&encryption=none#x%20y", "vless", "h{k}.example.com", "443", "tcp", None, None),
    (f"vmess://{b64('{port:8080,add:' + chr(39) + 'v.example' + chr(39) + ',id:' + ID + ',net:h2,host:/p,tls:tls,sni:s.example}')}", "vmess", "v.example", "8080", "http", "tls", "/p"),
    (f"vmess://{b64('{' + chr(34) + 'add' + chr(34) + ':' + chr(34) + 'w.example' + chr(34) + ',' + chr(34) + 'port' + chr(34) + ':' + chr(34) + '443' + chr(34) + ',' + chr(34) + 'id' + chr(34) + ':' + chr(34) + ID + chr(34) + '}')}", "vmess", "w.example", "443", "tcp", None, None),
    (f"trojan://p%40w{A}?security=none&type=ws&path=%2Fa%20b", "trojan", "h{k}.example.com", "443", "ws", None, "/a b"),
    (f"TROJAN://pw@8.8.4.4:443?security=reality&pbk=K2", "trojan", "8.8.4.4", "443", "tcp", "reality", "K2"),
    ("hysteria2://au@h{k}.example.com:2000-2010,2005-2020,443?obfs=salamander&obfs-password=w", "hy2", "h{k}.example.com", "443,2000-2020", None, "tls", "w"),
    ("hhysteria2://au@h{k}.example.com:53", "hy2", "h{k}.example.com", "53", None, "tls", None),
    (f"ss://{b64('aes-256-gcm:p:w@s.example:8388')}#n", "ss", "s.example", "8388", None, None, "p:w"),
    (f"shadowsocks://{b64('chacha20:pw')}{A}", "ss", "h{k}.example.com", "443", None, None, "pw"),
    (f"ssr://{b64('r.example:99:origin:rc4:plain:' + b64('pw') + '/?remarks=' + b64('nä')).rstrip('=')}", "ssr", "r.example", "99", None, None, "nä"),
    ("tg://socks?server=1.1.1.1&port=1080&secret=dd", "tg", "1.1.1.1", "1080", "socks", None, "dd"),
    ("https://t.me/proxy?server=tg.example&port=443&secret=ee", "tg", "tg.example", "443", "mtproto", None, "ee"),
    (f"tuic://{ID}:p%20w{A}?allowInsecure=0&alpn=h3", "tuic", "h{k}.example.com", "443", None, "tls", "p w"),
    (f"wireguard://aa%3D{A}?address=10.0.0.2&public_key=bb%3D&psk=cc", "wireguard", "h{k}.example.com", "443", None, None, "cc"),
], ("schema", "host", "port", "transport", "security", "more"))
def parse_shapes(links):
    c = parsed(links).select("k", "cfg.*")
    more = F.coalesce("pbk", "obfs_password", "preshared_key", "secret", F.when(F.col("schema") == "ss", F.col("password")), F.when(F.col("schema") == "tuic", F.col("password")), F.when(F.col("schema") == "ssr", F.col("remarks")), "path")
    return c.select("k", "schema", F.when(~F.col("host").contains("::"), F.col("host")).alias("host"), "port", "transport", "security", more.alias("more"))


@cases("parse_hostile", [
    (f"vmess://{b64('{add:a.example,port:1e999,id:x}')}", "InvalidPort"), (f"vmess://{b64('{add:a.example,port:NaN,id:x}')}", "InvalidPort"), ("trojan://p@h{k}.example.com:١٢", "InvalidPort"), ("hysteria2://a@h{k}.example.com:443-400", "InvalidPort"),
    ("vless://u@h{k}.example.com:70000", "InvalidPort"), (f"tuic://x:y{A}", "InvalidUserInfo"), ("ss://%%%@h{k}.example.com:1", "InvalidUserInfo"), ("trojan://p@a b:1", "InvalidHost"), ("trojan://p@127.0.0.1:1", "InvalidPrivateHost"),
    ("trojan://p@[fc00::{ip6}]:1", "InvalidPrivateHost"), ("trojan://p@h{k}.example.com", "MissingPort"), ("trojan://p@:443", "MissingHost"), ("vmess://AAAA", "InvalidStructure"), (f"wireguard://k{A}?publickey=x", "MissingConf"), (f"vless://u{A}?type=xhttp&mode=zzz", "InvalidConf"),
    ("undefined://x{k}", "PromotionUrl"), ("anytls://a@b.example:1", "UnsupportedScheme"), ("no link {k}", "InvalidStructure"),
], ("error_class",))
def parse_hostile(links):
    return parsed(links).select("k", "error_class")


@cases("parse_fallbacks", [
    ("ss://name@h{k}.example.com:1", "vless", "InvalidUserInfo"), (f"vmess://{ID}{A}?type=ws", "vless", "InvalidStructure"), (f"tuic://{b64('aes:pw')}{A}", "ss", "InvalidUserInfo"), ("trojan://p@h{k}.example.com:99999", None, "InvalidPort"), ("warp://a@b.example:1", None, "UnsupportedScheme"),
], ("parsed_as", "error_class"))
def parse_fallbacks(links):
    return parsed(links, fallback=True).select("k", "parsed_as", "error_class")


@cases("uri_rules", [
    ("vless://id@h{k}.example.com:1/a/b?x=a@b#f@g", "vless", "id", "h{k}.example.com:1", "/a/b", "x=a@b", "f@g"), ("trojan://abc#def?ghijklmn@h{k}.example.com:443?x=1", "trojan", "abc#def?ghijklmn", "h{k}.example.com:443", None, "x=1", None),
    ("vless://abc#def?ghijklmn@h{k}.example.com:443", "vless", "abc", None, None, None, "def?ghijklmn@h{k}.example.com:443"), ("vless://id@chan@h{k}.example.com:443#r", "vless", "id", "h{k}.example.com:443", None, None, "r"),
    ("ss://h{k}.example.com:80", "ss", "h{k}.example.com:80", "h{k}.example.com:80", None, None, None), ("https://t.me/proxy?server={k}", "https", "t.me", "t.me", "/proxy", "server={k}", None), ("SHADOWSOCKS://abc{k}?q", "ss", "abc{k}", None, None, "q", None),
    ("vless://u?p@h{k}.example.com:1", "vless", "u", None, None, "p@h{k}.example.com:1", None), ("trojan://p@[2001:db8::1]:443  ", "trojan", "p", "[2001:db8::1]:443", None, None, None), ("no scheme {k}", *NONE),
], ("scheme", "userinfo", "hostport", "path", "query", "fragment"))
def uri_rules(links):
    return links.withColumn("u", split_uri(F.col("raw"))).select("k", "u.*")


@cases("hostports", [
    ("h{k}.example.com:80", "h{k}.example.com", "80"), ("[2001:db8::1]:443", "2001:db8::1", "443"), ("2001:db8::1:443", "2001:db8::1", "443"), ("@@h{k}.example:1", "h{k}.example", "1"), ("x$*@h{k}.example:2", "h{k}.example", "2"), ("h{k}.example:20-30,40", "h{k}.example", "20-30,40"),
    ("h{k}.example:7&x=1", "h{k}.example", "7"), ("h{k}.example", "h{k}.example", None),
], ("host", "port"))
def hostports(links):
    return links.withColumn("p", S.split_hostport(F.col("raw"))).select("k", "p.*")


@cases("idna_hosts", [
    ("bücher.example", "xn--bcher-kva.example", None, "xn--bcher-kva.example", None), ("EXAMPLE.com", "example.com", None, "EXAMPLE.com", None), ("例子.测试", "xn--fsqu00a.xn--0zwm56d", None, "xn--fsqu00a.xn--0zwm56d", None), ("[2001:DB8:0::1]", None, "2001:db8::1", "2001:db8::1", None),
    ("[::ffff:1.2.3.4]", None, "1.2.3.4", "1.2.3.4", None), ("8.8.8.8", "8.8.8.8", None, "8.8.8.8", None), ("1.2.3.4.5", "1.2.3.4.5", None, None, "InvalidHost"),
], ("dns", "ip6", "host", "error_class"))
def idna_hosts(links):
    raw = F.col("raw")
    p = parsed(links.withColumn("bare", raw).withColumn("raw", F.concat(F.lit("trojan://p@"), raw, F.lit(":1"))))
    six = F.col("bare").contains(":")
    return p.select("k", F.when(~six, loose_json.idna_host(F.when(~six, F.col("bare")))).alias("dns"), F.when(six, loose_json.ipv6_text(F.when(six, F.col("bare")))).alias("ip6"), "cfg.host", "error_class")


@cases("channel_urls", [(x, "https://t.me/s/c{k}") for x in ("c{k}", "@c{k}", "https://t.me/c{k}", "http://t.me/s/c{k}", "  c{k} ")], ("url",))
def channel_urls(links):
    return links.select("k", S.channel_url(F.col("raw")).alias("url"))


@cases("unescape_remarks", [
    ("a%2520b{k}", "a%20b{k}"), ("x\\u00e9\\u{1F600}{k}", "xé😀{k}"), ("\\ud83d\\ude00{k}", "😀{k}"), ("tab\\t{k}\\x41", "tab\t{k}A"), ("bad\\q{k}", "bad\\q{k}"), ("100%z{k}", "100%z{k}"), ("%E9{k}", "é{k}"), ("plain {k}", "plain {k}"),
], ("remarks",))
def unescape_remarks(links):
    return links.select("k", loose_json.unescape(F.col("raw")).alias("remarks"))


@cases("rebuild_remarks", [(f"vless://{ID}{A}#%20x%5Cu00e9%2520y%20", f"vless://{ID}{A}#x%C3%A9%20y"), (f"tuic://{ID}:p{A}#%5Cu0041", f"tuic://{ID}:p{A}#A"), (f"trojan://p{A}#%5Cu0041", f"trojan://p{A}#%5Cu0041")], ("link",))
def rebuild_remarks(links):
    return parsed(links).select("k", records.rebuild(F.col("cfg")).alias("link"))


@cases("bools", [("1", "true"), (" YES ", "true"), ("false", "false"), ("no", "false"), ("maybe", None), ("", None)], ("flag",))
def bools(links):
    return links.select("k", S.to_bool(F.col("raw")).cast("string").alias("flag"))


HEX5 = "sha1(from_hex(repeat('0', 32)) || encode(name))"


@query("uuid_v5", f"""SELECT k, u AS by_column, u AS by_parser, name AS origin FROM (SELECT k, name, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS u
 FROM (SELECT k, name, {HEX5} AS h FROM (SELECT k, replace(name, '#', '-') AS name FROM {CUST})))""")
def uuid_v5(spark, d):
    c = customers(spark, d).withColumn("name", F.replace("name", F.lit("#"), F.lit("-"))).withColumn("raw", F.concat(F.lit("vless://"), "name", F.lit("@h.example.com:1")))
    return parsed(c).select("k", S.uuid5_nil(F.col("name")).alias("by_column"), F.col("cfg.uuid").alias("by_parser"), F.col("cfg.uuid_origin").alias("origin"))


@query("ssr_params_sorted", f"""SELECT k, 'ssr://' || rtrim(translate(base64(encode('h' || k || '.example.com:' || (k % 65535 + 1) || ':origin:rc4:plain:pw/?a=1&m=x&z=' || k || '&remarks=' || rtrim(translate(base64(encode(name)), '+/', '-_'), '='))), '+/', '-_'), '=') AS link FROM {CUST}""")
def ssr_params_sorted(spark, d):
    k, n = F.col("k"), F.col("name")
    inner = F.concat(L.host(k), F.lit(":"), L.port(k), F.lit(":origin:rc4:plain:pw/?z="), k.cast("string"), F.lit("&remarks="), S.b64_encode(n), F.lit("&m=x&a=1&a=2"))
    c = customers(spark, d).withColumn("raw", F.concat(F.lit("ssr://"), S.b64_encode(inner)))
    return parsed(c).select("k", records.rebuild(F.col("cfg")).alias("link"))


# blobs, batches, sources


@query("blob_forms", f"SELECT k, 'trojan://p@h' || k || '.example.com:443#a' || CASE WHEN k % 4 = 2 THEN chr(65533) ELSE '' END || 'b' AS raw_url FROM {CUST}")
def blob_forms(spark, d):
    """Padded, URL-safe and wrapped base64, plain text, and bytes that aren't UTF-8."""
    k = F.col("k")
    line = F.concat(F.lit("trojan://p@h"), k.cast("string"), F.lit(".example.com:443#ab"))
    raw = F.concat(F.regexp_replace(line, "b$", "").cast("binary"), F.unhex(F.lit("FF62")))
    packed = F.base64(line.cast("binary"))
    data = F.when(k % 4 == 0, packed.cast("binary")).when(k % 4 == 1, F.regexp_replace(F.translate(packed, "+/=", "-_"), "(.{20})", "$1\n").cast("binary")).when(k % 4 == 2, raw).otherwise(line.cast("binary"))
    return extract.extract_links(customers(spark, d).select("k", data.alias("data"))).select("k", "raw_url")


@query("batch_explode", r"SELECT doc_id, unnest(generate_series(0, len(ls) - 1))::INT AS pos, unnest(ls) AS raw_url FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)")
def batch_explode(spark, d):
    docs = L.table(spark, d, "documents").where("text IS NOT NULL")
    return extract.explode_batches(docs.select("doc_id", F.split("text", "\n", -1).alias("raw_urls")))


@query("read_sources", "SELECT 'https://s' || s_suppkey || '.example/x' AS url, CASE WHEN s_suppkey % 5 <> 0 THEN 'trojan://p@h' || s_suppkey || '.example.com:1' END AS data, CASE WHEN s_suppkey % 5 = 0 THEN 'down' END AS error FROM supplier")
def read_sources(spark, d):
    def fetch(url: str) -> bytes:
        k = int(url.partition("://s")[2].partition(".")[0])
        if k % 5 == 0:
            raise OSError("down")
        return f"trojan://p@h{k}.example.com:1".encode()

    urls = L.table(spark, d, "supplier").select(F.format_string("https://s%d.example/x", "s_suppkey").alias("url"))
    return readers.read_urls(urls, fetch).select("url", F.col("data").cast("string").alias("data"), "error")


@query("config_sources", "SELECT * FROM (VALUES ('https://t.me/s/one', 'telegram'), ('https://t.me/s/two', 'telegram'), ('https://s.example/x', 'subscription')) v(url, type)")
def config_sources(spark, d):
    return readers.read_config(spark, "tgchannel: [one, 'https://t.me/s/two', 7]\nsubscriptions:\n- https://s.example/x\n").select("url", "type")


@query("source_types", r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'telegram' WHEN regexp_matches(url, '^https?://') THEN 'subscription' ELSE 'other' END AS type FROM pages")
def source_types(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.lit("https://t.me/s/x")).otherwise(F.col("url"))
    return L.table(spark, d, "pages").select("page_id", store.source_type(url).alias("type"))


def _day(i: int) -> str:
    return f"2024-01-{i // 24 + 1:02d}T{i % 24:02d}:00:00+00:00"


def _message(channel: str, i: int, links: str) -> str:
    return (
        f'<div class="tgme_widget_message x" data-post="{channel}/{i}"><a class="tgme_widget_message_owner_name" href="https://t.me/{channel}/">n</a>'
        f'<div class="tgme_widget_message_text">{links}</div><time datetime="{_day(i)}"></time></div>'
    )


@query("channel_backfill", "SELECT 'https://t.me/s/c' || n_nationkey AS url, i AS msg_id, 1704067200 + i * 3600 AS ts FROM nation, generate_series(1, 60) t(i) WHERE n_nationkey % 4 <> 3 AND (CASE WHEN n_nationkey % 4 = 0 THEN i > 50 ELSE i >= n_nationkey END)")
def channel_backfill(spark, d):
    """Channels of 60 messages in pages of ten, read back to a cut-off; without one the last page alone; some fail."""
    def fetch(url: str) -> bytes:
        name, _, until = url.rpartition("/")[2].partition("?before=")
        if int(name[1:]) % 4 == 3:
            raise OSError("HTTP status 500")
        last = int(until or 61)
        return "".join(_message(name, i, "trojan://p@h.example.com:1#m") for i in range(max(1, last - 10), last)).encode()

    k = F.col("n_nationkey")
    channels = L.table(spark, d, "nation").select(F.format_string("https://t.me/s/c%d", k).alias("url"), F.when(k % 4 != 0, 1704067200 + k * 3600).alias("cutoff"))
    return readers.read_channels(channels, fetch).select("url", "msg_id", "ts")


@query("page_bounds", "SELECT n_nationkey AS k, n_nationkey + 1 AS first_id, 1704067200 + (n_nationkey + 1) * 3600 AS oldest FROM nation")
def page_bounds(spark, d):
    import pandas as pd

    def bounds(batches):
        for b in batches:
            got = [readers.page_bounds("".join(_message("c", k + i, "x") for i in (3, 1, 2))) for k in b["k"]]
            yield pd.DataFrame({"k": b["k"], "first_id": [g[0] for g in got], "oldest": [int(g[1]) for g in got]})

    return L.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")).mapInPandas(bounds, "k long, first_id long, oldest long")


@query("html_messages", f"""SELECT k, k AS msg_id, 'chan' AS user, 1704067200 AS ts, unnest([0, 1])::INT AS pos, unnest(['trojan://p@h' || k || '.example.com:443?a=1&b=2#' || replace(name, '#', '%23'), 'ss://x@h' || k || '.example.com:1']) AS raw_url FROM {CUST} WHERE k % 5 NOT IN (1, 2, 3)""")
def html_messages(spark, d):
    """Messages with links, without any, without a time, and cut short by the page."""
    k = F.col("k")
    html = F.concat(
        F.lit('<html><div class="tgme_widget_message" data-post="chan/'), k.cast("string"), F.lit('"><a class="tgme_widget_message_owner_name" href="https://t.me/chan">c</a><div class="tgme_widget_message_text js">'),
        F.when(k % 5 == 1, F.lit("no <b>links</b>")).when(k % 5 == 3, F.lit("<code>trojan://p@h.example.com:443#cut…</code>")).otherwise(F.concat(F.lit("see: <code>trojan://p@h"), k.cast("string"), F.lit(".example.com:443?a=1&amp;b=2#"), F.replace("name", F.lit("#"), F.lit("%23")), F.lit("</code><br/>or Shadowsocks://x@h"), k.cast("string"), F.lit(".example.com:1```<br>bye"))),
        F.lit("</div>"), F.when(k % 5 != 2, F.lit('<time datetime="2024-01-01T00:00:00+00:00">t</time>')).otherwise(F.lit("")), F.lit("</div></html>"),
    )
    found = extract.page_messages(customers(spark, d).select("k", html.alias("html")))
    return found.select("k", "msg_id", "user", "ts", F.posexplode("raw_urls").alias("pos", "raw_url"))


# tables


@query("filter_all", f"SELECT id FROM {SRV} WHERE schema IN ('click', 'view') AND first_seen_ts >= {EARLY} AND id IN (SELECT server_id FROM {EV} WHERE seen_ts >= (SELECT (min(seen_ts) + max(seen_ts)) // 2 FROM {EV}))")
def filter_all(spark, d):
    s = store.sightings_of(events(spark, d))
    return store.query_servers(_servers(spark, d), s, min_last_seen=_cut(spark, d), protocols=["click", "view"], min_first_seen=_cut(spark, d, 200), flag_mask=1).select("id")


@query("server_lookup", f"SELECT id, schema, 'h' AS host, '1' AS port, 'tcp' AS transport, 'tls' AS security, remarks, '{{}}' AS raw_config, first_seen_ts, first_seen_source_id, 7::BIGINT AS sig, 1 AS flags, first_seen_ts AS flags_ts, NULL::VARCHAR AS ping, NULL::BIGINT AS ping_ts FROM {SRV} WHERE id = 7")
def server_lookup(spark, d):
    return store.get_server(_servers(spark, d), 7)


@query("servers_full", f"SELECT id, schema, 'h' AS host, '1' AS port, 'tcp' AS transport, 'tls' AS security, remarks, '{{}}' AS raw_config, first_seen_ts, first_seen_source_id, 7::BIGINT AS sig, 1 AS flags, first_seen_ts AS flags_ts, NULL::VARCHAR AS ping, NULL::BIGINT AS ping_ts FROM {SRV}")
def servers_full(spark, d):
    return _servers(spark, d)


@query("server_ages", f"SELECT schema, min(age) AS youngest, max(age) AS oldest, avg(age) AS mean, count(*) AS n FROM (SELECT schema, 2000000000 - first_seen_ts AS age FROM {SRV}) GROUP BY schema")
def server_ages(spark, d):
    return store.ages(_servers(spark, d), 2_000_000_000)


@query("registry_misses", f"SELECT seq FROM {EV} WHERE event_type NOT IN ('click', 'view')")
def registry_misses(spark, d):
    known = store.upsert_sources(store.empty(spark, store.SOURCES), events(spark, d).where("event_type IN ('click', 'view')"), "event_type")
    return store.fk_violations(events(spark, d), known, "source_id").select("seq")


@query("pipeline_merge", f"""SELECT id, schema, host, first_seen_ts, n FROM (SELECT 'h' || k || '.example.com' AS host, 'trojan' AS schema, CASE WHEN k % 2 = 0 THEN 50 ELSE 100 END AS first_seen_ts, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS n,
 xor({STABLE.format("'trojan' || chr(31) || 'tls' || chr(31) || 'grpc' || chr(31) || chr(31) || chr(31) || 's' || (k % 7) || '.example.org' || chr(31) || chr(31)")}, {STABLE.format("'h' || k || '.example.com:' || (k % 65535 + 1) || ':' || md5(name) || ':' || md5(name)")}) AS id FROM {CUST})""")
def pipeline_merge(spark, d):
    """Two downloads, the later one older; each customer's link in the first, every second in the other."""
    def blob(rows: DataFrame, url: str) -> DataFrame:
        lines = rows.groupBy((F.col("k") % 16).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("raw_url")), "\n").cast("binary").alias("data"))  # a sixteenth of the test table
        return lines.select(F.concat(F.lit(url), F.col("part").cast("string")).alias("url"), "data")

    links = linked(spark, d, "trojan")
    p = Pipeline(spark).add_blobs(blob(links, "https://a.example/"), 100).add_blobs(blob(links.where("k % 2 = 0"), "https://b.example/"), 50).run()
    n = p.sightings.groupBy(F.col("server_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return p.servers.join(n, "id").select("id", "schema", "host", "first_seen_ts", "n")


@query("dead_letter_fields", f"""SELECT raw_url, CASE k % 8 WHEN 5 THEN 'warp' WHEN 6 THEN 'ss' ELSE 'trojan' END AS scheme, CASE k % 8 WHEN 6 THEN {MSG} || ' (parsed as vless)' ELSE {MSG} END AS error, {STABLE.format("'https://t.me/s/x'")} AS source_id, 'telegram' AS source_type, k::BIGINT AS timestamp
 FROM (SELECT k, CASE k % 8 WHEN 5 THEN 'warp://a@b.example.com:1' WHEN 6 THEN 'ss://aes:pw@h' || k || '.example.com:80' ELSE 'trojan://pw@h' || k || '.example.com' END AS raw_url FROM {CUST} WHERE k % 8 IN (5, 6, 7))""")
def dead_letter_fields(spark, d):
    rows = mixed(spark, d).withColumn("url", F.lit("https://t.me/s/x")).withColumn("seen_ts", F.col("k").cast("long"))
    return store.dead_letters(store.unparseable(records.parse_links(rows)))


@query("export_file", """SELECT row_number() OVER (ORDER BY part, key, key2, id) AS place, line FROM (
 SELECT 0 AS part, '' AS key, '' AS key2, 0 AS id, '# now' AS line UNION ALL SELECT 1, '', '', 0, '# Sources:' UNION ALL SELECT 3, '', '', 0, ''
 UNION ALL SELECT DISTINCT 2, 'https://s' || (c_custkey % 3) || '.example', '', c_custkey % 3, '# https://s' || (c_custkey % 3) || '.example' FROM customer
 UNION ALL SELECT 4, 'ss', coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_name END, chr(1114111)), c_custkey, 'ss://' || rtrim(translate(base64(encode('aes-256-gcm:' || md5(c_name))), '+/', '-_'), '=') || '@h' || c_custkey || '.example.com:' || (c_custkey % 65535 + 1) FROM customer)""")
def export_file(spark, d):
    """A whole file: stamp, sources in use by url, links by protocol and remarks, those without remarks last."""
    p = records.parse_links(linked(spark, d, "ss"))
    k = F.col("k")
    servers = p.select(k.cast("long").alias("id"), "cfg.schema", F.when(k % 4 > 0, F.col("cfg.remarks")).alias("remarks"), (k % 3).cast("long").alias("first_seen_source_id"), "cfg")
    sources = spark.createDataFrame([(i, f"https://s{i}.example") for i in range(5)], "id long, url string")
    lines = store.export_lines(servers, sources, records.rebuild(F.col("cfg")), "now")
    return placed(lines.orderBy("part", "key", "key2", "id").select("line"))


@query("round_robin_mix", "SELECT p_brand, p_partkey, row_number() OVER (ORDER BY rn, p_brand) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM (SELECT DISTINCT p_brand, p_partkey FROM part)) WHERE rn <= 100")
def round_robin_mix(spark, d):
    parts = L.table(spark, d, "part").select("p_brand", "p_partkey")
    return store.round_robin(parts.union(parts), "p_brand", [F.col("p_partkey")], 100).select("p_brand", "p_partkey", "place")


# lists


@query("wl_none", f"SELECT k, 0 AS flags FROM {CUST}")
def wl_none(spark, d):
    """One list missing: no flag at all."""
    names, ips, _ = lists(spark, d)
    rows = customers(spark, d).select("k", L.host(F.col("k")).alias("host"))
    return whitelist.with_flags(rows, F.col("host"), F.lit(None).cast("string"), names, ips, None).drop("host")


@query("wl_sni", f"SELECT k, CASE WHEN k % 2 = 0 AND k IN (SELECT 3 * n_nationkey FROM nation) THEN 1 ELSE 0 END AS flags FROM {CUST}")
def wl_sni(spark, d):
    """The sni alone is listed, in upper case, beside a host that isn't."""
    k = F.col("k")
    rows = customers(spark, d).select("k", F.lit("other.example").alias("host"), F.when(k % 2 == 0, F.upper(L.host(k))).alias("sni"))
    return whitelist.with_flags(rows, F.col("host"), F.col("sni"), *lists(spark, d)).select("k", "flags")


FLAGS_SQL = f"coalesce(CASE WHEN {SNI_SQL} THEN 1 END, 0) + coalesce(CASE WHEN {NET_SQL} THEN 2 END, 0) + coalesce(CASE WHEN {IP_SQL} THEN 4 END, 0)"


@query("wl_recheck", f"SELECT k AS id, CASE WHEN k % 3 < 2 THEN {FLAGS_SQL} ELSE 9 END AS flags, CASE WHEN k % 3 < 2 THEN 5000 ELSE 1000 END AS flags_ts FROM {HOSTS} h")
def wl_recheck(spark, d):
    """Flags of stale rows (never set, or before the cut-off) are computed again; the rest stays."""
    k = F.col("k")
    host = F.when(k % 2 == 0, L.host(k)).otherwise(L.ip(k))
    config = F.to_json(F.struct(F.lit("ss").alias("schema"), host.alias("host")))
    rows = customers(spark, d).select(k.cast("long").alias("id"), config.alias("raw_config"), F.lit(9).alias("flags"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 10).otherwise(1000).cast("long").alias("flags_ts"))
    return recheck(rows, lists(spark, d), 5000, 100).select("id", "flags", "flags_ts")


# pings


def _pings(spark, d) -> DataFrame:
    """One result for each of the first 50 endpoints."""
    k = F.col("k")
    status = F.struct(F.when(k % 5 == 0, "Fail").otherwise("Done").alias("type"), F.when(k % 5 != 0, k + F.lit(0.5)).alias("latency_ms"), F.when(k % 5 == 0, "timeout").alias("error"))
    return customers(spark, d).where("k <= 50").select(F.upper(L.host(k)).alias("host"), F.lit("443").alias("port"), F.lit("tcp").alias("kind"), status.alias("status"))


PING_SQL = """CASE WHEN h % 5 = 0 THEN '{"kind":"tcp","status":{"type":"Fail","error":"timeout"}}' ELSE '{"kind":"tcp","status":{"type":"Done","latency_ms":' || (h + 0.5) || '}}' END"""


@query("ping_writeback", f"SELECT k, CASE WHEN h <= 50 THEN {PING_SQL} END AS ping, CASE WHEN h <= 50 THEN 99 END AS ping_ts FROM (SELECT k, k % 100 AS h FROM {CUST})")
def ping_writeback(spark, d):
    """Every server of an endpoint takes its result; others keep none."""
    k = F.col("k")
    servers = customers(spark, d).select("k", L.host(k % 100).alias("host"), F.lit("443").alias("port"), F.lit(None).cast("string").alias("ping"), F.lit(None).cast("long").alias("ping_ts"))
    results = _pings(spark, d).select("host", "port", ping.ping_json(F.col("kind"), F.col("status")).alias("ping"), F.lit(99).cast("long").alias("ping_ts"))
    return store.apply_pings(servers, results).select("k", "ping", "ping_ts")


@query("ping_join", f"SELECT k, CASE WHEN h % 5 = 0 THEN 'Fail' ELSE 'Done' END AS type FROM (SELECT k, k % 100 AS h FROM {CUST}) WHERE h <= 50 AND k % 3 > 0")
def ping_join(spark, d):
    """Servers with a usable port and a result; the others are left out."""
    k = F.col("k")
    servers = customers(spark, d).select("k", L.host(k % 100).alias("host"), F.when(k % 3 == 0, "0").otherwise("443").alias("port"))
    return ping.with_results(servers, _pings(spark, d)).select("k", "status.type")


@query("ping_errors", f"SELECT k, {chosen(['', 'connection timed out after 3s', 'connection refused: no', 'DNS resolution failed: no name', 'network error: net'])} AS error, CASE WHEN k % 5 = 0 THEN 7.5::DOUBLE END AS latency_ms FROM {CUST}".replace("WHEN 0 THEN ''", "WHEN 0 THEN NULL"))
def ping_errors(spark, d):
    import socket

    def probe(host: str, port: int, kind: str) -> float:
        errors = (None, TimeoutError(), ConnectionRefusedError("no"), socket.gaierror("no name"), OSError("net"))
        if e := errors[port % 5]:
            raise e
        return 7.5

    targets = customers(spark, d).select("k", F.lit("h.example").alias("host"), F.col("k").cast("string").alias("port"), F.lit("tcp").alias("kind"))
    return ping.ping(targets, probe).select(F.col("port").cast("long").alias("k"), "status.error", "status.latency_ms")


@query("ping_totals", f"SELECT count(*) FILTER (WHERE seq % 5 <> 0) AS ok, count(*) FILTER (WHERE seq % 5 = 0) AS fail, count(*) AS total FROM {EV}")
def ping_totals(spark, d):
    ok = F.col("status.type") == "Done"
    return _results(spark, d).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("fail"), F.count(F.lit(1)).alias("total"))


@query("summary_json", f"""SELECT '{{"by_scheme":{{' || string_agg('"' || event_type || '":{{"ok":' || ok || ',"fail":' || fail || ',"total":' || n || '}}', ',' ORDER BY event_type) || '}},"total":{{"ok":' || sum(ok) || ',"fail":' || sum(fail) || ',"total":' || sum(n) || '}}}}' AS summary
 FROM (SELECT event_type, count(*) FILTER (WHERE seq % 5 <> 0) AS ok, count(*) FILTER (WHERE seq % 5 = 0) AS fail, count(*) AS n FROM {EV} GROUP BY event_type)""")
def summary_json(spark, d):
    return store.summary_json(store.scheme_totals(_results(spark, d).withColumn("schema", F.col("event_type")), F.col("status.type") == "Done"))


@query("protocol_urls", f"SELECT schema, count(*) AS n FROM (SELECT DISTINCT {MIXED} AS schema, name FROM {CUST}) WHERE schema IS NOT NULL GROUP BY schema")
def protocol_urls(spark, d):
    """Distinct (protocol, link) pairs by protocol, of a corpus that holds every link twice."""
    rows = records.parse_links(mixed(spark, d), fallback=False).where("cfg IS NOT NULL").select("cfg.schema", "raw_url")
    return rows.union(rows).distinct().groupBy("schema").agg(F.count(F.lit(1)).alias("n"))
