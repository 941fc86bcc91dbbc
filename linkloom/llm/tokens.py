"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES

_COACHES: dict[str, WordIds] = {}


class WordIds:
    """ids(texts) equals encode(text, add_special_tokens=False).ids of each
    text: strings of special tokens that stand in a text get their ids. Where
    the file's rules never let a token span white space, texts are cut at
    those strings, and between them words are looked up in a bounded cache and
    only unseen words are encoded."""

    def __init__(self, path: str, room: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.special = {t["content"]: np.asarray([t["id"]], "<u4").tobytes() for t in added}
        names = sorted(self.special, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        as_they_stand = all(t.get("special") and not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
        suffix = spec["model"].get("end_of_word_suffix")
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_word = as_they_stand and kinds == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Split" and pre.get("behavior") == "Removed" and "[^\\s\\p{L}\\p{N}]+" in str((pre.get("pattern") or {}).get("Regex")) and bool(suffix)
        self.room = room
        self._forget()
        if self.by_word:
            self.tok.encode_special_tokens = True  # texts are cut at them before; a word that lower case makes alike is none
            vocab = self.tok.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True

    def _forget(self) -> None:
        """place: a number for each known word; data, first and size: the ids of all words by it."""
        self.place: dict[str, int] = {}
        self.data, self.first, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        letters = [w for w in new if w.isalpha()]
        rest = [w for w in new if not w.isalpha()]
        ids, sizes = [], []
        if letters:  # one text; a word ends where a token does that ends words
            many = self._plain([" ".join(letters)])[0]
            ends = np.flatnonzero(self.ends[many]) + 1
            if len(ends) == len(letters) and ends[-1] == len(many):
                ids.append(many)
                sizes.append(np.diff(ends, prepend=0))
            else:
                letters, rest = [], new
        each = self._plain(rest)
        ids += each
        sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        size = np.concatenate(sizes)
        self.place.update(zip(letters + rest, range(len(self.place), len(self.place) + len(size)), strict=True))
        self.first = np.concatenate([self.first, len(self.data) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.data = np.concatenate([self.data, *ids])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_word:
            return [x.tobytes() for x in self._plain(texts)]
        if any(name in t for name in self.special for t in texts):
            parts = [self.cuts.split(t) for t in texts]  # every second part is a special token
            coded = iter(self._joined([p for x in parts for p in x[::2]]))
            return [b"".join(self.special[p] if i % 2 else next(coded) for i, p in enumerate(x)) for x in parts]
        return self._joined(texts)

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Texts are cut at ASCII white space, and each different word before a
        comma or stop at its end, where a token ends after letters; each
        different part is looked up once."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
        coded = words.flatten().dictionary_encode()
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(coded.dictionary, r"(\pL)([.,])$", r"\1 \2"))
        known = parts.flatten().dictionary_encode()
        names = known.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.place.get, names))
        if None in found:
            new = [w for w, i in zip(names, found, strict=True) if i is None]
            if len(self.place) + len(new) > self.room:
                self._forget()
                new = names
            for i in range(0, len(new), 1 << 14):  # the tokenizer's own records of a text are large
                self._learn(new[i : i + (1 << 14)])
            found = list(map(self.place.__getitem__, names))
        found = np.array(found, np.int64)
        data, cuts = _gathered(self.data, self.first[found], self.size[found], known.indices.to_numpy())
        cuts = cuts[parts.offsets.to_numpy()]
        data, cuts = _gathered(data, cuts[:-1], np.diff(cuts), coded.indices.to_numpy())
        cuts = cuts[words.offsets.to_numpy()].tolist()
        return [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of data that at names, laid end to end, and where each begins."""
    n = size[at]
    ends = np.append(0, np.cumsum(n))
    return data[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])], ends


def word_ids(path: str) -> WordIds:
    """One for each Python worker and file."""
    CACHES["tokens"] = _COACHES.clear
    if path not in _COACHES:
        _COACHES[path] = WordIds(path)
    return _COACHES[path]
