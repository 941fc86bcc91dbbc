"""Licence scans by a positional rare-token index."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The word of each base phrase under which it is indexed.
ANCHOR = {"under the mit license": "mit", "apache license version 2": "apache", "cc by nc": "cc"}


@dataclass(frozen=True)
class Template:
    """A licence's notice, and phrases of it that a file must hold word for word."""

    label: str
    text: str
    key: tuple[str, ...]


TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsd", "distributed under the bsd license", ("bsd license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",)),
    Template("gpl-2", "gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("mpl-2", "mozilla public license version 2 0", ("mozilla public license version 2",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by", "creative commons attribution 4 0 international", ("creative commons attribution 4",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "creative commons attribution sharealike", ("creative commons attribution sharealike",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("above copyright notice and this permission notice", "substantial portions of the software")),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses license 2 0")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain", "this list of conditions and the following disclaimer")),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license as published", "either version 2 of the license")),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license as published", "either version 3 of the license")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license as published",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("subject to the terms of the mozilla public license",)),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2",)),
    Template("bsl-1", "distributed under the boost software license version 1 0", ("boost software license version 1",)),
    Template("zlib", "provided as is without any express or implied warranty in no event will the authors be held liable", ("without any express or implied warranty", "will the authors be held liable")),
)
#: Words of notices that say nothing about a licence; they are verified, not indexed.
COMMON = frozenset(
    "a above all an and any are as at available be by code copies copy either event except file files following for form forms free held http in into is it list made "
    "may must no not notice of or org person provided purpose released shall source subject terms that the this to under use v version will with without www you 0 1 2 3 4".split()
)


def words(text: Column) -> Column:
    """Words of the whole text, A-Z lowered; null has none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORDS), 0)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


#: A template as the index holds it: its rarest word and the other indexed
#: words, with their places, and its key phrases with theirs.
POSTING = "label:string,parts:array<string>,word:string,place:int,others:array<struct<word:string,places:array<int>>>,keys:array<struct<place:int,words:array<string>>>,least:int"
#: The word of a file at a place from 0; null outside.
AT = "try_element_at(ws, if({0} >= 0, {0} + 1, 1073741824))"
#: For each template that a file with hits holds, its label and the largest
#: share of its words in place: every place of the rarest word is tried, the
#: other words' postings vote, and the key phrases must stand word for word.
FOUND = f"""
filter(transform(postings, t -> named_struct('label', t.label, 'share', array_max(transform(
  filter(
    filter(
      transform(filter(hits, x -> x.w = t.word), x -> x.p - t.place),
      off -> 1 + size(filter(t.others, o -> exists(o.places, j -> {AT.format("off + j")} <=> o.word))) >= t.least),
    off -> forall(t.keys, k -> off + k.place >= 0 AND slice(ws, greatest(off + k.place, 0) + 1, size(k.words)) = k.words)),
  off -> size(filter(sequence(0, size(t.parts) - 1), j -> {AT.format("off + j")} <=> t.parts[j])) / size(t.parts))))),
  x -> x.share IS NOT NULL)"""


def index(templates: tuple[Template, ...], df: dict[str, int], min_votes: int) -> list[dict]:
    """Under each template's indexed word of the highest IDF among those that
    its key phrases need: who holds the phrases holds that word in that place."""
    out = []
    for t in templates:
        parts = t.text.split()
        keys = []
        for phrase in t.key:
            p = phrase.split()
            keys.append((next(i for i in range(len(parts)) if parts[i : i + len(p)] == p), p))
        inside = [j for i, p in keys for j in range(i, i + len(p)) if parts[j] not in COMMON]
        at = min(inside, key=lambda j: (df.get(parts[j], 0), parts[j], j))
        words_ = sorted({w for w in parts if w not in COMMON})
        others = [{"word": w, "places": [j for j, x in enumerate(parts) if x == w]} for w in words_ if w != parts[at]]
        out.append({"label": t.label, "parts": parts, "word": parts[at], "place": at, "others": others, "keys": [{"place": i, "words": p} for i, p in keys], "least": min(min_votes, len(words_))})
    return out


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, min_votes: int = 2) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score.

    One pass over the texts finds, in each file, the places of the words that
    the templates' index holds. Their inverse document frequencies count all
    files, and give each template its rarest word among those its key phrases
    need. At each place of that word the other words' postings are intersected
    by relative position: min_votes different words (all of a shorter
    template's) in their places make a candidate, and a candidate whose key
    phrases all stand there word for word gives its label. score is the
    largest share of a template's words that stand in place, 1 where a base
    phrase is found, 0 without a label. All of it is computed inside the
    file's row: no file is shuffled, and none of its words is left out.

    Base phrases are counted at every place, from the same index. Null and
    empty text has no words, no label (empty string) and score 0. Repeated
    rows are scanned each. Columns of those names are replaced.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    docs = docs.drop(*new)
    vocab = sorted({w for t in templates for w in t.text.split() if w not in COMMON} | set(ANCHOR.values()))
    others = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0))
    ws = docs.select(row.alias("row"), words(F.col(text)).alias("ws"))
    at = F.filter(F.transform("ws", lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda x: x["w"].isin(vocab))
    known = F.arrays_overlap("ws", _strings(vocab))
    found = ws.select("row", F.size("ws").cast("long").alias("n_words"), F.when(known, F.col("ws")).alias("ws")).withColumn("hits", at)
    found = save(found, "hits")
    frequency = found.where("hits IS NOT NULL").select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w")).groupBy("w").count().collect()  # at most the vocabulary
    postings = index(templates, {r["w"]: r["count"] for r in frequency}, min_votes)

    def places(phrase: str) -> Column:
        parts = phrase.split()
        back = parts.index(ANCHOR[phrase])
        here = F.filter("hits", lambda x: (x["w"] == ANCHOR[phrase]) & (x["p"] >= back) & (F.slice(F.col("ws"), F.greatest(x["p"] - back, F.lit(0)) + 1, len(parts)) == _strings(parts)))
        return F.transform(here, lambda x: F.struct((x["p"] - back).cast("long").alias("p"), F.lit(BASE[phrase]).alias("label")))

    base = F.coalesce(F.concat(*[places(p) for p in BASE]), F.array().cast("array<struct<p:bigint,label:string>>"))
    kept = found.select("*", base.alias("base"), F.from_json(F.lit(json.dumps(postings)), f"array<struct<{POSTING}>>").alias("postings"))  # a constant
    best = F.when(F.size("hits") > 0, F.expr(FOUND))
    files = kept.select("row", "n_words", "base", F.coalesce(best, F.array().cast("array<struct<label:string,share:double>>")).alias("best"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("best", lambda x: x["label"])))
    count = F.size("base").cast("long")
    values = {
        "n_words": F.col("n_words"),
        "n_base": count,
        "first_word": F.array_min(F.transform("base", lambda x: x["p"])),
        "last_word": F.array_max(F.transform("base", lambda x: x["p"])),
        "base_labels": F.array_join(base_labels, ","),
        "labels": F.array_join(labels, ","),
        "score": F.when(count > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("best", lambda x: x["share"])), F.lit(0.0))),
    }
    return files.select(*[F.col(f"row.`{c}`").alias(c) for c in others], *[v.alias(k) for k, v in values.items()])
