"""Links, hosts, ports and permissive JSON, one by one (no Spark)."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.functions import scalars as S
from linkloom.functions.linkbuild import FORMS, b64, build, enc
from linkloom.functions.linkparse import FALLBACKS, PARSERS, address, check_public, host_name, parse, pct, port_number, port_spec, split
from linkloom.functions.linkparse import b64 as read_b64
from linkloom.functions.loose_json import dump, loose_json, normalize_extras_text, unescape_text
from linkloom.operators.records import FIELDS
from linkloom.operators.uri import split_uri


LOOSE = {
    # quotes, separators, commas, words
    "{'a':'b'}": {"a": "b"}, "{'a'='b'}": {"a": "b"}, "{a:b}": {"a": "b"}, "{a=b,c:d}": {"a": "b", "c": "d"}, "{'k':[['v',],],}": {"k": [["v"]]}, "{k:True}": {"k": True}, "{k:false,n:None}": {"k": False, "n": None},
    "{'it':'it's'}": {"it": "it's"}, '{"a":"say "hi" now"}': {"a": 'say "hi" now'}, "{,a:1,,b:2,}": {"a": 1, "b": 2}, "[1,,2]": [1, 2], "None": None, "{}": {}, "[]": [], "''": "",
    # numbers, plus signs as spaces
    "[+1, +2]": [1, 2], "+1.5": 1.5, "+1e3": 1000.0, "{n:-7}": {"n": -7}, "{v:007}": {"v": "007"}, "{v:1.2.3.4}": {"v": "1.2.3.4"}, '{+"a":+"x-y",+"b":+{+"c":+0}}': {"a": "x-y", "b": {"c": 0}}, "+true": True,
    # escapes and coding
    '{\\"a\\":\\"b\\"}': {"a": "b"}, '{"a":"\\u00e9\\n"}': {"a": "é\n"}, "%7B%22a%22%3A1%7D": {"a": 1}, "%7B%22a%22%3A%2B1%7D": {"a": 1}, '{"a":1}': {"a": 1}, "  {a:1}": {"a": 1},
    # equal keys: the first wins in loose text
    "{a:1,a:2}": {"a": 1}, "{'p':'%7C'}": {"p": "%7C"},
}


@pytest.mark.parametrize("text", LOOSE)
def test_loose_json(text):
    assert json.loads(dump(loose_json(text)[0])) == LOOSE[text]


@pytest.mark.parametrize("text", [None, "", "{", '{"a":', '{"a":"x', "{'a'", "[1", "{a}", ",", "{a:1", "[[[", "{:}"])
def test_unreadable_json(text):
    assert loose_json(text) is None


def test_json_tail():
    assert loose_json("{a:1}&x=1")[1] == "&x=1" and loose_json('{"a":1} tail')[1] == " tail"


@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12))
@settings(max_examples=200, deadline=None)
def test_strict_json_is_read_as_it_is(value):
    assert loose_json(json.dumps(value))[0] == value


@given(st.sampled_from([*PARSERS, "hhy2", "odd", "TROJAN"]), st.text(max_size=60), st.booleans())
@settings(max_examples=600, deadline=None)
def test_any_link_gives_a_row(scheme, rest, coded):
    for raw in (f"{scheme}://{b64(rest) if coded else rest}", f"{scheme}://u@h.example:1{rest}", f"{scheme}://{rest}@h.example:1?{rest}#{rest}"):
        cfg, kind, text, found = parse(raw)
        assert (cfg is not None) or kind
        assert found is None or found in FALLBACKS
        if cfg:
            assert set(cfg) <= set(FIELDS)
            build({k: cfg.get(k) for k in FIELDS})


def test_deep_and_odd_documents():
    for body in ("[" * 100_000, '{"a":' * 5000, '{"port":1e999,"add":"a.example","id":"x"}', '{"port":[1],"add":"a.example","id":"x"}', '{"add":{"x":1}}', '{"port":NaN,"add":"a.example","id":"x"}'):
        for scheme in ("vmess", "stormdns"):
            assert parse(f"{scheme}://{b64(body)}", False)[0] is None


@pytest.mark.parametrize(("text", "wanted"), [("a%20b", "a b"), ("caf\\u00e9", "café"), ("\\ud83d\\ude00", "😀"), ("\\u{1F600}", "😀"), ("x\\q", "x\\q"), ("%FFz", "ÿz"), ("a\\", "a\\"), ("\\u{110000}", "\\u{110000}"), ("\\ud83d", "\ufffd"), (None, None), ("", "")])
def test_unescape(text, wanted):
    assert unescape_text(text) == wanted


def test_forms_cover_the_formats():
    assert set(FORMS) == set(PARSERS)


URIS = [
    "vless://id@h.example:1/a?x=1#f@g", "trojan://abc#def?ghijklmn@h.example:443?x=1", "vless://abc#def?ghijklmn@h.example:443", "vless://id@chan@h.example:443#r", "ss://h.example:80", "https://t.me/proxy?server=1", "SHADOWSOCKS://abc?q",
    "vless://u?p@h.example:1", "trojan://p@[2001:db8::1]:443", "no scheme", "tg://proxy?server=a", "vmess://abc", "ss://a@b@c:1", "x://", "trojan://0123456789abcde#@h.example:1", "trojan://0123456789abcdef@h.example:1#x", "hy2://a@h:1,2-3/?x#", "ss://1.2.3.4:80/p", "://x",
]
PORTS = ["1", "65535", "65536", "0", "20-30", "30-20", "1,2-5,4-9", "1-", "a", "", "١٢", "5,5", "1-2,3"]
HOSTS = ["localhost", "a.localhost", "10.0.0.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "169.254.0.1", "127.1.2.3", "8.8.8.8", "::1", "fc00::1", "fe80::1", "2001:db8::1", "h.example", "fd.example", "10.example"]
CODED = ["", "YQ", "YQ==", "YWI=", "YWJj", "YWJj#x", "_-8", "+/8=", "+-8", "Y", "YWJ", "aGk`", "4pyT", "////"]


def test_columns_and_parsers_agree(spark):
    """The column forms and those that the parsers use say the same."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(URIS)), "i int, x string").select("i", split_uri(F.col("x")).alias("u")).collect()
    for r in rows:
        wanted = split(URIS[r.i])
        blank = lambda d: d and {k: d[k] or None for k in ("scheme", "userinfo", "hostport", "path", "query", "fragment")}
        assert blank(r.u and r.u.asDict()) == blank(wanted), URIS[r.i]

    def ported(text):
        try:
            return port_spec(text)
        except Exception:  # noqa: BLE001
            return None

    got = {r.x: r.p for r in spark.createDataFrame([(p,) for p in PORTS], "x string").select("x", S.port_text(S.port_ranges(F.col("x"))).alias("p")).collect()}
    assert got == {p: ported(p) for p in PORTS}

    def private(host):
        try:
            check_public(*host_name(host))
        except Exception:  # noqa: BLE001
            return True
        return False

    got = {r.x: r.p for r in spark.createDataFrame([(h,) for h in HOSTS], "x string").select("x", S.private_host(F.col("x")).alias("p")).collect()}
    assert got == {h: private(h) for h in HOSTS}
    got = {r.x: (r.p or "", r.e, r.b) for r in spark.createDataFrame([(c,) for c in CODED], "x string").select("x", S.b64_decode(F.col("x")).alias("p"), S.pct_encode(F.col("x")).alias("e"), S.b64_encode(F.col("x")).alias("b")).collect()}
    assert got == {c: (read_b64(c) or "", enc(c), b64(c)) for c in CODED}
    got = {r.x: r.p for r in spark.createDataFrame([("a%20b+c",), ("100%",), ("%FF",), ("é%C3%A9",)], "x string").select("x", S.pct_decode(F.col("x")).alias("p")).collect()}
    assert got == {x: pct(x) for x in got}
    for bad in ("١٢", "1 ", "", "-1", "99999"):
        with pytest.raises(Exception):
            port_number(bad)


def test_ports_and_hosts():
    assert port_spec("100-120,122")
    assert host_name("例子.测试")[0] == "xn--fsqu00a.xn--0zwm56d"
    assert address("例子.测试:443")[:2] == ("xn--fsqu00a.xn--0zwm56d", "443")
    for bad in ("̀", "‍", " "):
        with pytest.raises(Exception):
            host_name(bad)


@pytest.mark.parametrize("raw", [None, "", "x", "://", "vless://", "vmess://!!", "ss://", "ssr://%%%", "tuic://@:0", "wireguard://a@b:c", "trojan://p@h.example:70000", "hy2://a@[::1]:1"])
def test_broken_links_are_errors(raw):
    cfg, cls, msg, _ = parse(raw, False)
    assert cfg is None and (cls or raw in (None, ""))


def test_good_links():
    cfg, cls, _, _ = parse("trojan://pw@host.example:443?security=tls&type=ws&path=/p&sni=b.example#n%20m")
    assert cls is None
    assert (cfg["host"], cfg["port"], cfg["password"], cfg["transport"], cfg["sni"], cfg["remarks"]) == ("host.example", "443", "pw", "ws", "b.example", "n m")
    cfg, cls, _, _ = parse("hy2://auth@[2001:4860::1]:13599?insecure=1&sni=c.example")
    assert cls is None and cfg["port"] == "13599"
    assert parse("trojan://pw@192.168.0.1:443")[1] == "InvalidPrivateHost"


def test_extras():
    assert normalize_extras_text("vless://h?extra={a:1}&x=1") == "vless://h?extra=%7B%22a%22%3A1%7D&x=1"
    assert normalize_extras_text(None) is None
