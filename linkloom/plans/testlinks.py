"""Links made from table columns, so that expected fields are known apart from the parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import b64_encode, pct_encode


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def host(k: Column) -> Column:
    return F.concat(F.lit("h"), k.cast("string"), F.lit(".example.com"))


def port(k: Column) -> Column:
    return (k % 65535 + 1).cast("string")


def ip(k: Column) -> Column:
    """A public address: 20 to 99 in the first place."""
    return F.concat_ws(".", (k % 80 + 20).cast("string"), (k % 200).cast("string"), (k % 250).cast("string"), (k % 254 + 1).cast("string"))


def secret(name: Column) -> Column:
    return F.md5(name)


def uuid(name: Column) -> Column:
    h = F.md5(name)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def link(schema: str, k: Column, name: Column) -> Column:
    """One link of the format for key k and name."""
    at = F.concat(host(k), F.lit(":"), port(k))
    frag = F.concat(F.lit("#"), pct_encode(name))
    sni = F.concat(F.lit("s"), (k % 7).cast("string"), F.lit(".example.org"))
    s = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    forms = {
        "vless": s("vless://", uuid(name), "@", at, "?type=ws&security=tls&sni=", sni, "&path=%2Fp%20", (k % 5).cast("string"), frag),
        "vmess": s("vmess://", b64_encode(s('{"add":"', host(k), '","port":"', port(k), '","id":"', uuid(name), '","net":"ws","path":"/v","tls":"tls","sni":"', sni, '","aid":"0","ps":"', name, '"}'))),
        "trojan": s("trojan://", secret(name), "@", at, "?type=grpc&sni=", sni, frag),
        "hy2": s("hysteria2://", secret(name), "@", at, "?insecure=1&sni=", sni, "&obfs=salamander&obfs-password=x", (k % 3).cast("string"), frag),
        "ss": s("ss://", b64_encode(s("aes-256-gcm:", secret(name))), "@", at, frag),
        "ssr": s("ssr://", b64_encode(s(host(k), ":", port(k), ":origin:aes-128-cfb:plain:", b64_encode(name), "/?group=g", (k % 4).cast("string"), "&remarks=", b64_encode(name)))),
        "tg": s("tg://proxy?server=", host(k), "&port=", port(k), "&secret=", secret(name)),
        "slipnet": s("slipnet://", b64_encode(s("1|dns|x|", host(k), "|a|b|c|d|", port(k), "|e|f|", secret(name), "|g")), frag),
        "slipnet-enc": s("slipnet-enc://", secret(name)),
        "stormdns": s("stormdns://", b64_encode(s('{"schema":"whitedns.profile","version":1,"profile":{"name":"', name, '","server":{"domain":"', host(k), '","encryption_key":"', secret(name), '","encryption_method":', (k % 4).cast("string"), "}}}"))),
        "tuic": s("tuic://", uuid(name), ":", secret(name), "@", at, "?congestion_control=bbr&alpn=h3&allow_insecure=1&sni=", sni, frag),
        "wireguard": s("wireguard://", pct_encode(s(secret(name), "=")), "@", at, "?address=10.0.0.2%2F32&publickey=", pct_encode(s(secret(name), "+/=")), "&mtu=1280", frag),
    }
    return forms[schema]
