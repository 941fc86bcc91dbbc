"""From blobs and pages to single links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.loose_json import normalize_extras, normalize_extras_text
from ..functions.scalars import SCHEMES

#: Scheme spellings that begin a link, in order of trial (fixed values).
STARTS = (
    "vless", "vmess", "trojan", "hysteria2", "hysteria", "hhysteria2", "hhysteria", "hy2", "hhy2", "hy", "shadowsocksr", "shadowsocks",
    "ssr", "ss", "slipnet-enc", "slipnet", "stormdns", "tuic", "wireguard", "https", "tg", "warp", "anytls",
)
_ANY = "(?:" + "|".join(STARTS) + ")://"


def decode_blob(data: Column) -> Column:
    """A downloaded body as text: base64 of either alphabet is decoded, text
    stays; invalid UTF-8 becomes replacement characters."""
    text = F.regexp_replace(F.make_valid_utf8(data.cast("string")), r"[\s=]+$", "")
    packed = F.regexp_replace(text, r"\s", "")
    plain = F.translate(packed, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    raw = F.when(packed.rlike(r"^[A-Za-z0-9+/_-]+$") & (F.length(plain) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))
    return F.coalesce(F.make_valid_utf8(raw.cast("string")), text)


def content_lines(text: Column, newline: str = r"\r?\n", cut: str | None = "<br/>") -> Column:
    """Lines that may hold links: no blanks (spaces of any alphabet), no # or //
    comments, without spaces before them, cut at <br/> (None: whole)."""
    lines = F.transform(F.split(text, newline), lambda x: F.ltrim(x))  # not F.ltrim: its second argument would be the line's place
    lines = F.filter(lines, lambda x: x.rlike(r"[^\p{Zs}]") & ~x.startswith("#") & ~x.startswith("//"))
    return lines if cut is None else F.flatten(F.transform(lines, lambda x: F.split(x, cut)))


def slice_links(line: Column) -> Column:
    """The links in a line, each up to the next; a line without one is an
    undefined:// link unless it can't be any."""
    hits = F.regexp_extract_all(line, F.lit(f"(?is){_ANY}.*?(?={_ANY}|\\z)"), 0)
    odd = line.rlike(r"^[\x21-\x3B\x3D-\x7E]") & (F.instr(line, "://") <= 1)
    return F.when(F.size(hits) > 0, hits).when(odd, F.array(F.concat(F.lit("undefined://"), line))).otherwise(F.array().cast("array<string>"))


def extract_links(blobs: DataFrame, data: str = "data", extras: bool = True) -> DataFrame:
    """One row a link: raw_url, pos (its place in the blob), and the other
    columns of blobs. Blobs without links give no row."""
    text = decode_blob(F.col(data))
    decoded = blobs.withColumn("__text", text)
    if extras:  # the Arrow function sees only blobs that need it
        some = F.col("__text").contains("extra=")
        decoded = decoded.withColumn("__text", F.when(some, normalize_extras(F.when(some, F.col("__text")))).otherwise(F.col("__text")))
    links = F.flatten(F.transform(content_lines(F.col("__text")), slice_links))
    return decoded.select(*[c for c in blobs.columns if c != data], F.posexplode(links).alias("pos", "raw_url")).withColumn("raw_url", F.rtrim("raw_url"))


class _Page(HTMLParser):
    """Messages of a public channel page."""

    def __init__(self):
        super().__init__()
        self.found: list[dict] = []
        self.depth = 0
        self.text_at: int | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kind = (a.get("class") or "").split()
        if tag == "br":
            if self.text_at is not None:
                self.found[-1]["text"] += "\n"
            return
        if tag in ("img", "meta", "link", "input", "hr"):
            return
        self.depth += 1
        if tag == "div" and "tgme_widget_message" in kind and a.get("data-post"):
            self.found.append({"id": a["data-post"].rpartition("/")[2], "user": None, "time": None, "text": ""})
        elif self.found:
            if tag == "a" and "tgme_widget_message_owner_name" in kind:
                self.found[-1]["user"] = (a.get("href") or "").rstrip("/").rpartition("/")[2]
            elif tag == "time" and a.get("datetime"):
                self.found[-1]["time"] = a["datetime"]
            elif "tgme_widget_message_text" in kind and self.text_at is None:
                self.text_at = self.depth

    def handle_endtag(self, tag):
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        if self.text_at == self.depth:
            self.text_at = None
        self.depth -= 1

    def handle_data(self, data):
        if self.text_at is not None and self.found:
            self.found[-1]["text"] += data


def text_links(text: str) -> list[str]:
    """Links in the text of a message: one a line, none that the page cut short."""
    out = []
    for line in text.split("\n"):
        head, sep, body = line.partition("://")
        if sep:
            scheme = head.split()[-1].lower() if head.split() else ""
            link = f"{SCHEMES.get(scheme, scheme)}://{body}".rstrip().rstrip("`")
            if body.strip() and not link.endswith(("…", "…»")):
                out.append(normalize_extras_text(link))
    return out


def page_messages(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row a message with links: msg_id, user, ts, raw_urls, and the other
    columns of pages. Messages without id, time or links are dropped."""
    others = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                page = _Page()
                page.feed(r[html] or "")
                for m in page.found:
                    links = text_links(m["text"])
                    if links and m["id"].isdigit() and m["time"]:
                        rows.append([*(r[c] for c in others), int(m["id"]), m["user"], m["time"], links])
            yield pd.DataFrame(rows, columns=[*others, "msg_id", "user", "time", "raw_urls"])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "msg_id long, user string, time string, raw_urls array<string>"])
    out = pages.mapInPandas(run, schema)
    return out.withColumn("ts", F.unix_seconds(F.to_timestamp("time"))).drop("time")


def paragraphs(html: Column) -> Column:
    """Text of the <p> elements of a page, tags removed, <br> as newline."""
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1)
    return F.transform(inner, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", "")))


def explode_batches(batches: DataFrame) -> DataFrame:
    """Batches of links (raw_urls) to rows in order, numbered by seq: batch order, then place."""
    return batches.select(*[c for c in batches.columns if c != "raw_urls"], F.posexplode("raw_urls").alias("pos", "raw_url"))
