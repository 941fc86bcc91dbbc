"""Decomposition of share-links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import after, before, blank, canonical_scheme, find, host_kind, split_hostport

#: A host with an optional port and nothing after it.
_ADDRESS = r"^(\[[0-9A-Fa-f:.]+\]|[^:/?#&=@\[\]]+)(:\d+)?$"


def _address(c: Column, dotted: bool) -> Column:
    hp = split_hostport(c)
    kind = host_kind(hp["host"])
    ok = c.rlike(_ADDRESS) & kind.isNotNull()
    return F.coalesce(ok & ((kind != "dns") | hp["host"].contains(".")) if dotted else ok & hp["port"].isNotNull(), F.lit(False))


def split_uri(raw: Column) -> Column:
    """struct<scheme, userinfo, hostport, path, query, fragment>, null without "://".

    The user part ends at the first @ that stands before the first # (before
    the first ? if there is no #). A trojan password of 16 ASCII characters
    may hold # or ? if an address follows it. Without a user part, an address
    is both userinfo and hostport, and anything else up to ? is userinfo."""
    s = F.rtrim(raw)
    scheme = canonical_scheme(before(s, "://"))
    rest = after(s, "://")
    at = find(rest, "@")
    early = F.when(rest.contains("#"), find(rest, "#")).otherwise(find(rest, "?"))
    tail = F.regexp_extract(after(rest, "@"), r"^[^/?#]*", 0)
    odd = (scheme == "trojan") & (at == 16) & rest.rlike(r"^[\x00-\x7F]{16}@") & _address(tail, False)
    split = (at >= 0) & ((early < 0) | (at < early) | odd)

    left = before(rest, "#")
    base = before(left, "?")
    bare = before(base, "/")
    address = _address(bare, True)
    alone = F.struct(
        scheme.alias("scheme"),
        F.when(address, bare).otherwise(base).alias("userinfo"),
        F.when(address, bare).alias("hostport"),
        F.when(address & base.contains("/"), F.concat(F.lit("/"), after(base, "/"))).alias("path"),
        blank(after(left, "?")).alias("query"),
        after(rest, "#").alias("fragment"),
    )
    body = after(rest, "@")
    noted = before(body, "#")
    place = before(noted, "?")
    front = before(place, "/")
    full = F.struct(
        scheme.alias("scheme"),
        before(rest, "@").alias("userinfo"),
        blank(F.coalesce(after(front, "@"), front)).alias("hostport"),
        F.when(place.contains("/"), F.concat(F.lit("/"), after(place, "/"))).alias("path"),
        blank(after(noted, "?")).alias("query"),
        after(body, "#").alias("fragment"),
    )
    return F.when(s.contains("://"), F.when(split, full).otherwise(alone))
