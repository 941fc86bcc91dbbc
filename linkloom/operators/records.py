"""The twelve link formats: parsing to one typed record, identities, rebuilding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linkbuild import build
from ..functions.linkparse import parse
from ..functions.scalars import stable64

#: Fields of a record and their types; every format fills some of them.
FIELDS = dict(
    schema="string", host="string", port="string", uuid="string", uuid_origin="string", password="string", method="string",
    protocol="string", obfs="string", obfs_password="string", auth="string", up="string", down="string", transport="string",
    transport_host="string", transport_mode="string", transport_extra="string", path="string", security="string", sni="string",
    alpn="string", fp="string", insecure="boolean", pbk="string", sid="string", spx="string", enc="string", encryption="string",
    flow="string", splice="boolean", alter_id="string", params="map<string,string>", secret="string", tunnel_type="string",
    public_key="string", raw_fields="array<string>", data="string", encryption_key="string", congestion_control="string",
    udp_relay_mode="string", private_key="string", address="string", preshared_key="string", reserved="string", mtu="string",
    remarks="string",
)
RECORD = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"



def parse_links(df: DataFrame, raw: str = "raw_url", fallback: bool = True) -> DataFrame:
    """df with cfg (the record, or null), error_class, error_msg and parsed_as
    (the format that a fallback found; the first error stays beside it).

    Reading a link branches on its content all the way down, which as column
    expressions gives plans too large to optimise; it is one Arrow-batched
    pass without a shuffle, and everything after it is native."""
    names = [c for c in df.columns if c not in ("cfg", "error_class", "error_msg", "parsed_as")]
    kind = f"struct<cfg:{RECORD},error_class:string,error_msg:string,parsed_as:string>"
    keys = list(FIELDS)
    out_type = pa.struct([("cfg", pa.struct([(k, _ARROW[t]) for k, t in FIELDS.items()])), *((n, pa.string()) for n in ("error_class", "error_msg", "parsed_as"))])

    @F.arrow_udf(kind)
    def read(links: pa.Array) -> pa.Array:
        rows = []
        for link in links.to_pylist():
            cfg, *rest = parse(link, fallback)
            rows.append({"cfg": None if cfg is None else {k: cfg.get(k) for k in keys}, **dict(zip(("error_class", "error_msg", "parsed_as"), rest, strict=True))})
        for r in rows:
            if r["cfg"] and r["cfg"]["params"]:
                r["cfg"]["params"] = sorted(r["cfg"]["params"].items())
        return pa.array(rows, out_type)

    done = df.select(*names).withColumn("__p", read(F.col(raw)))
    return done.select(*names, F.col("__p.cfg").alias("cfg"), F.col("__p.error_class").alias("error_class"), F.col("__p.error_msg").alias("error_msg"), F.col("__p.parsed_as").alias("parsed_as"))


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}


# identities


def _hash(*parts: Column) -> Column:
    """Never 0, so that 0 can stand for none."""
    h = stable64(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.when(h == 0, 1).otherwise(h)


def cred_hash(c: Column) -> Column:
    """Hash of host:port:user:password as the format defines them."""
    pairs = {
        "vless": ("uuid", "uuid"), "vmess": ("uuid", "uuid"), "trojan": ("password", "password"), "hy2": ("auth", "auth"), "ss": ("method", "password"),
        "ssr": ("method", "password"), "tg": ("secret", "secret"), "stormdns": (None, "encryption_key"), "tuic": ("uuid", "password"),
        "wireguard": ("private_key", "private_key"), "slipnet": (None, None),
    }
    out = F.when(c["schema"] == "slipnet-enc", F.lit(1).cast("long"))
    for schema, (user, word) in pairs.items():
        text = F.concat_ws(":", *[F.coalesce(v, F.lit("")) for v in (c["host"], c["port"], c[user] if user else F.lit(""), c[word] if word else F.lit(""))])
        h = stable64(text)
        out = out.when(c["schema"] == schema, F.when(h == 0, 1).otherwise(h))
    return out


SIG = {
    "vless": ("security", "transport", "transport_host", "path", "encryption", "sni", "flow", "alpn", "fp", "pbk", "sni", "splice"),
    "vmess": ("enc", "transport", "transport_host", "alter_id", "sni"),
    "trojan": ("security", "transport", "transport_host", "path", "sni", "alpn", "fp"),
    "hy2": ("security", "obfs", "obfs_password", "insecure", "sni", "up", "down"), "ss": ("method",), "tg": ("transport",), "slipnet": ("tunnel_type",),
    "stormdns": ("enc",), "tuic": ("congestion_control", "udp_relay_mode", "alpn", "insecure", "sni"),
    "wireguard": ("address", "public_key", "preshared_key", "reserved", "mtu"),
}


def sig(c: Column) -> Column:
    """Hash of what a server is, without its address and credentials; fields are kept apart."""
    out = F.when(c["schema"] == "slipnet-enc", F.lit(1).cast("long"))
    for schema, names in SIG.items():
        out = out.when(c["schema"] == schema, _hash(F.lit(schema), *[F.coalesce(c[n], F.lit("none")) if n == "security" else c[n] for n in names]))
    keyed = F.array_join(F.transform(F.array_sort(F.map_keys(c["params"])), lambda k: F.concat(k, F.lit("="), F.element_at(c["params"], k))), "\x1f")
    return out.when(c["schema"] == "ssr", _hash(F.lit("ssr"), keyed))


def uid(c: Column) -> Column:
    return sig(c).bitwiseXOR(cred_hash(c))


def raw_config(c: Column) -> Column:
    """The record as JSON, without its nulls."""
    return F.to_json(c)


def from_config(text: Column) -> Column:
    return F.from_json(text, RECORD)


# rebuilding


@F.arrow_udf(T.StringType())
def _built(records: pa.Array) -> pa.Array:
    return pa.array([build(r) for r in records.to_pylist()], pa.string())


def rebuild(c: Column) -> Column:
    """The canonical link of a record; null if it lacks what its format needs.

    Twelve formats, nested JSON and the unescaping of remarks make a column
    expression of thousands of nodes, which costs more to plan than this
    Arrow-batched pass costs to run."""
    return _built(c)
