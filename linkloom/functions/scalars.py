"""Column expressions over link text: coding, queries, hosts, ports, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical scheme by lower-case spelling (fixed values).
SCHEMES = {
    "vless": "vless", "vmess": "vmess", "trojan": "trojan", "ss": "ss", "shadowsocks": "ss", "ssr": "ssr", "shadowsocksr": "ssr",
    "hysteria2": "hy2", "hhysteria2": "hy2", "hy2": "hy2", "hhy2": "hy2", "hysteria": "hy", "hhysteria": "hy", "hy": "hy", "hhy": "hy",
    "tg": "tg", "https": "https", "slipnet": "slipnet", "slipnet-enc": "slipnet-enc", "stormdns": "stormdns", "tuic": "tuic",
    "wireguard": "wireguard", "warp": "warp", "anytls": "anytls", "undefined": "undefined",
}


def lit_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def blank(c: Column) -> Column:
    """null for null or empty."""
    return F.when(c != "", c)


def find(c: Column, what: str) -> Column:
    """0-based place of what, -1 if absent."""
    return F.instr(c, what) - 1


def before(c: Column, what: str) -> Column:
    """Text before the first what; all of it if absent."""
    return F.substring_index(c, what, 1)


def after(c: Column, what: str) -> Column:
    """Text after the first what; null if absent."""
    at = F.instr(c, what)
    return F.when(at > 0, c.substr(at + len(what), F.length(c)))


def canonical_scheme(c: Column) -> Column:
    """Known schemes by their canonical name, others in lower case."""
    return F.coalesce(F.try_element_at(lit_map(SCHEMES), F.lower(c)), F.lower(c))


def pct_decode(c: Column) -> Column:
    """Percent-decoding: plus signs and stray percent signs stay, and a text
    that isn't UTF-8 afterwards stays as it was."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    plain = F.coalesce(F.try_url_decode(safe), c)
    lossy = plain.contains("\ufffd") & ~c.contains("\ufffd") & ~F.upper(c).contains("%EF%BF%BD")
    return F.when(lossy, c).otherwise(plain)


def pct_encode(c: Column) -> Column:
    """Percent-encoding of all but A-Z a-z 0-9 - _ . ~"""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _cut64(c: Column) -> Column:
    body = F.regexp_extract(F.replace(c, F.lit("`"), F.lit("")), "^[A-Za-z0-9+/_=-]*", 0)
    ended = F.regexp_extract(body, "^(.*==)", 1)
    once = F.regexp_extract(body, "^(.*=)", 1)
    body = F.when(ended != "", ended).when(once != "", once).otherwise(body)
    return F.rtrim(body, F.lit("="))


def b64_bytes(c: Column) -> Column:
    """The bytes of the base64 text that c begins with, of either alphabet but
    not both, padded or not; null if it isn't canonical base64."""
    body = _cut64(c)
    mixed = body.rlike("[+/]") & body.rlike("[-_]")
    plain = F.translate(body, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    raw = F.try_to_binary(padded, F.lit("base64"))
    same = F.rtrim(F.regexp_replace(F.base64(raw), "\\s", ""), F.lit("=")) == plain
    return F.when(~mixed & (F.length(plain) % 4 != 1) & same, raw)


def b64_decode(c: Column) -> Column:
    """b64_bytes as text, with replacement characters for what isn't UTF-8."""
    return F.make_valid_utf8(b64_bytes(c).cast("string"))


def b64_encode(c: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(c.cast("binary")), "\\s", ""), "+/", "-_"), F.lit("="))


def query_pairs(c: Column) -> Column:
    """array<struct<k,v>> in order, duplicates kept; parts without = are dropped and values decoded."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "&"), lambda x: x.contains("="))
    return F.transform(parts, lambda x: F.struct(before(x, "=").alias("k"), pct_decode(x.substr(F.instr(x, "=") + 1, F.length(x))).alias("v")))


def query_get(pairs: Column, *keys: str) -> Column:
    """The first value of the first key that is there."""
    def first(key: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda x: x["k"] == F.lit(key)), F.lit(1))["v"]

    return F.coalesce(*map(first, keys)) if len(keys) > 1 else first(keys[0])


IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def ipv4_int(c: Column) -> Column:
    """A dotted IPv4 address as an unsigned number; null otherwise."""
    p = F.split(c, "\\.")
    n = sum((p[i].cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), p[0].cast("long") * (1 << 24))
    return F.when(c.rlike(IPV4), n)


def int_ipv4(c: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(c, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def cidr_bounds(c: Column) -> Column:
    """struct<lo, hi> of a.b.c.d/0..32; null if malformed."""
    ip, mask = ipv4_int(before(c, "/")), F.try_to_number(after(c, "/"), F.lit("99")).cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - mask).cast("long")
    lo = ip - ip % size
    return F.when(after(c, "/").rlike(r"^\d{1,2}$") & (mask <= 32) & ip.isNotNull(), F.struct(lo.alias("lo"), (lo + size - 1).alias("hi")))


#: Addresses that no server may have: loopback, private and link-local (fixed values).
PRIVATE4 = r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)"
PRIVATE6 = r"^(::1$|(0*:){7}0*1$|f[cd][0-9a-f]*:|fe[89ab][0-9a-f]?:)"


def private_host(host: Column) -> Column:
    """localhost, *.localhost, and private, loopback or link-local addresses."""
    low = F.lower(F.regexp_replace(host, r"[\[\]]", ""))
    four = low.rlike(PRIVATE4) & low.rlike(IPV4)
    return F.coalesce((low == "localhost") | low.endswith(".localhost") | four | low.rlike(PRIVATE6), F.lit(False))


def host_kind(host: Column) -> Column:
    """dns, ipv4, ipv6 or null (not a host)."""
    return (
        F.when(host.rlike(IPV4), "ipv4")
        .when(host.rlike(r"^\[?[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]?$"), "ipv6")
        .when(host.rlike(r"^\d+\.\d+\.\d+\.\d+\."), F.lit(None))
        .when(host.rlike(r"^[A-Za-z0-9._\x{80}-\x{10FFFF}-]+$"), "dns")
    )


HOSTPORT = r"^(?:.*\$\*@|@)*(\[[0-9A-Fa-f:.]+\]|[^:/?#&=\[\]]*|[0-9A-Fa-f:.]*:[0-9A-Fa-f.]*(?=:[0-9]))(?::([0-9][0-9,-]*))?(?:[/?&].*|[^:]*=.*)?$"


def split_hostport(c: Column) -> Column:
    """struct<host, port>: brackets go; the last group of a bare IPv6 address is the port; host in lower case as typed."""
    host = F.regexp_replace(F.regexp_extract(c, HOSTPORT, 1), r"[\[\]]", "")
    return F.struct(blank(host).alias("host"), blank(F.regexp_extract(c, HOSTPORT, 2)).alias("port"))


def u16(c: Column) -> Column:
    """A whole or fractional number in text as an unsigned 16-bit integer; null otherwise."""
    d = F.when(F.trim(c).rlike(r"^\d+(\.\d+)?$"), F.floor(F.trim(c).cast("double")))
    return F.when(d.between(0, 65535), d.cast("int"))


def to_bool(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("1", "true", "yes"), True).when(low.isin("0", "false", "no"), False)


def port_ranges(c: Column) -> Column:
    """array<struct<lo,hi>> of '1-3,5', sorted and merged where ranges overlap;
    null if malformed, over 65535, or with a range that ends before it begins."""
    parts = F.transform(F.split(c, ","), lambda x: F.struct(before(x, "-").cast("int").alias("lo"), F.coalesce(after(x, "-"), x).cast("int").alias("hi")))
    kind = "array<struct<lo:int,hi:int>>"
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["lo"] <= F.try_element_at(acc, F.lit(-1))["hi"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["lo"].alias("lo"), F.greatest(F.try_element_at(acc, F.lit(-1))["hi"], x["hi"]).alias("hi")))),
    ).otherwise(F.concat(acc, F.array(x)))
    fine = c.rlike(r"^[0-9]{1,5}(-[0-9]{1,5})?(,[0-9]{1,5}(-[0-9]{1,5})?)*$") & F.forall(parts, lambda x: (x["lo"] <= x["hi"]) & (x["hi"] <= 65535))
    return F.when(fine, F.aggregate(F.array_sort(parts), F.array().cast(kind), step))


def port_text(ranges: Column) -> Column:
    one = F.transform(ranges, lambda x: F.when(x["lo"] == x["hi"], x["lo"].cast("string")).otherwise(F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string"))))
    return F.array_join(one, ",")


def port_list(ranges: Column) -> Column:
    return F.flatten(F.transform(ranges, lambda x: F.sequence(x["lo"], x["hi"])))


UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def uuid5_nil(c: Column) -> Column:
    """UUID version 5 of the text in the nil namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("0" * 32)), c.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stable64(c: Column) -> Column:
    """60 bits of md5 as a non-negative long: equal in any engine."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def channel_url(c: Column) -> Column:
    """A channel's name, @name or address as its public page."""
    return F.concat(F.lit("https://t.me/s/"), F.regexp_replace(F.trim(c), r"^(https?://t\.me/(s/)?|@)", ""))


def duration_seconds(text: str) -> int:
    """Seconds of a duration such as 7d, 1h30m or 45s."""
    import re

    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    found = re.findall(r"(\d+)\s*([smhdw])", text)
    if not found or re.sub(r"\d+\s*[smhdw]|\s", "", text):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * unit[u] for n, u in found)
