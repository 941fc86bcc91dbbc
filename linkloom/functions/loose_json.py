"""Reading of JSON as people paste it, and what builds on it."""

from __future__ import annotations

import json
import re
from urllib.parse import quote, unquote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORDS = {"true": True, "false": False, "null": None, "none": None}
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][-+]?\d+)?")


class _Reader:
    """A recursive reader: single, escaped or no quotes, = for :, spare commas,
    + as white space, Python words; the first of two equal keys wins."""

    def __init__(self, text: str):
        self.t, self.i = text, 0

    def space(self, also: str = "") -> None:
        while self.i < len(self.t) and (self.t[self.i].isspace() or self.t[self.i] in "+" + also):
            self.i += 1

    def peek(self) -> str:
        if self.i >= len(self.t):
            raise ValueError("ends early")
        return self.t[self.i]

    def value(self):
        self.space()
        c = self.peek()
        if c == "{":
            return self.members()
        if c == "[":
            return self.items()
        if c in "\"'" or self.t.startswith('\\"', self.i):
            return self.quoted()
        return self.bare()

    def members(self) -> dict:
        self.i += 1
        out: dict = {}
        while True:
            self.space(",")
            if self.peek() == "}":
                self.i += 1
                return out
            key = self.quoted() if self.peek() in "\"'\\" else self.word(":=,}")
            self.space()
            if self.peek() not in ":=":
                raise ValueError("no value")
            self.i += 1
            got = self.value()
            out.setdefault(str(key), got)

    def items(self) -> list:
        self.i += 1
        out: list = []
        while True:
            self.space(",")
            if self.peek() == "]":
                self.i += 1
                return out
            out.append(self.value())

    def quoted(self) -> str:
        if self.peek() == "\\":
            self.i += 1
        q, out = self.peek(), []
        self.i += 1
        while True:
            c = self.peek()
            self.i += 1
            if c == "\\":
                n = self.peek()
                self.i += 1
                if n == q and re.match(r"\s*[:=,}\]]", self.t[self.i :]) and not re.search(q, self.t[self.i :].split("}")[0].replace("\\" + q, "")):
                    return "".join(out)
                if n == "u" and re.match(r"[0-9a-fA-F]{4}", self.t[self.i :]):
                    out.append(chr(int(self.t[self.i : self.i + 4], 16)))
                    self.i += 4
                else:
                    out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(n, n))
            elif c == q and re.match(r"[\s+]*([:=,}\]]|$)", self.t[self.i :]):
                return "".join(out)
            else:
                out.append(c)  # a quote inside the text

    def word(self, stop: str) -> str:
        a = self.i
        while self.peek() not in stop:
            self.i += 1
        return self.t[a : self.i].strip(" \t\r\n+'\"")

    def bare(self):
        if m := _NUMBER.match(self.t, self.i):
            if re.match(r"[\s+]*[,}\]]|$", self.t[m.end() :]):
                self.i = m.end()
                return json.loads(m[0]) if not re.match(r"-?0\d", m[0]) else m[0]
        for w, v in _WORDS.items():
            if self.t[self.i : self.i + len(w)].lower() == w and not self.t[self.i + len(w) : self.i + len(w) + 1].isalnum():
                self.i += len(w)
                return v
        w = self.word(",}]")
        if not w:
            raise ValueError("no value")
        return w


def loose_json(text: str | None):
    """(value, tail) of what text begins with; None if it can't be read."""
    if text is None:
        return None
    t = text.lstrip()
    try:
        value, end = json.JSONDecoder().raw_decode(t)
        return value, t[end:]
    except ValueError:
        pass
    if re.match(r"%(7b|5b|22|27)", t, re.I):
        t = unquote(t, encoding="latin-1")  # one character a byte
    for s in (t, t.replace("[", '"[', 1)):
        r = _Reader(s)
        try:
            return r.value(), r.t[r.i :]
        except (ValueError, RecursionError):
            continue
    return None


def dump(value) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def normalize_extras_text(text: str | None) -> str | None:
    """After each extra= the JSON is read, written with sorted keys and
    percent-encoded; what can't be read stays."""
    if text is None or "extra=" not in text:
        return text
    head, *rest = text.split("extra=")
    out = [head]
    for part in rest:
        got = loose_json(part)
        out.append(part if got is None or not isinstance(got[0], dict | list) else quote(dump(got[0]), safe="-_.~") + got[1])
    return "extra=".join(out)


@F.pandas_udf(T.StringType())
def _loose(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if (g := loose_json(t)) is None else dump(g[0]), na_action="ignore")


@F.pandas_udf(T.StringType())
def _extras(c: pd.Series) -> pd.Series:
    return c.map(normalize_extras_text, na_action="ignore")


#: Letters that stand for control characters after a backslash.
_CONTROLS = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([abfnrtv\\'\"/])|(.)|$)", re.S)


def unescape_text(text: str | None) -> str | None:
    """Percent-decoding, a guess of the charset (UTF-8, else Windows-1252), then
    backslash escapes, pairs of surrogates too; a text with an unknown one keeps its backslashes."""
    if text is None:
        return None
    raw = unquote_to_bytes(text)
    try:
        plain = raw.decode()
    except UnicodeDecodeError:
        plain = raw.decode("cp1252", "replace")
    bad = False

    def one(m: re.Match) -> str:
        nonlocal bad
        code = m[1] or m[2] or m[3]
        if code:
            n = int(code, 16)
            bad |= n > 0x10FFFF
            return "" if n > 0x10FFFF else chr(n)
        bad |= m[4] is None
        return _CONTROLS.get(m[4], m[4] or "")

    out = _ESCAPE.sub(one, plain).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return plain if bad else out


@F.pandas_udf(T.StringType())
def _unescape(c: pd.Series) -> pd.Series:
    return c.map(unescape_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _idna(c: pd.Series) -> pd.Series:
    import idna

    def one(host: str) -> str | None:
        try:
            return host.lower() if host.isascii() else idna.encode(host, uts46=True).decode()
        except idna.IDNAError:
            return None

    return c.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def _ipv6(c: pd.Series) -> pd.Series:
    import ipaddress

    def one(host: str) -> str | None:
        try:
            a = ipaddress.IPv6Address(host.strip("[]"))
        except ValueError:
            return None
        return str(a.ipv4_mapped) if a.ipv4_mapped else str(a)

    return c.map(one, na_action="ignore")


def read_json(c: Column) -> Column:
    """Compact JSON text of loosely written JSON; null if unreadable."""
    return _loose(c)


def normalize_extras(c: Column) -> Column:
    return _extras(c)


def unescape(c: Column) -> Column:
    """Remarks as they are meant: see unescape_text. Only text with a percent
    sign or a backslash goes through the Arrow function."""
    some = c.rlike(r"[%\\]")
    return F.when(some, _unescape(F.when(some, c))).otherwise(c)


def idna_host(c: Column) -> Column:
    return _idna(c)


def ipv6_text(c: Column) -> Column:
    return _ipv6(c)
