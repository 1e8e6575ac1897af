"""Token ids by the tokenizers library, with a cache of pre-tokens.

BPE works within pre-tokens, so the ids of a text are those of its pre-tokens
in a row. Texts whose characters and their lower case are all below U+0250
(without controls) are split here by the tokenizer's own pattern and looked
up; new pre-tokens go through the library together, and all other texts go
through it whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: Characters end here for which the patterns below are made.
LAST = 0x250


def _plain(c: str) -> bool:
    low = c.lower()
    return len(low) == 1 and ord(low) < LAST and (c in "\t\n\r" or unicodedata.category(c) not in ("Cc", "Zs") or c == " ")


_ODD = re.compile("[^" + "".join(re.escape(c) for c in map(chr, range(LAST)) if _plain(c)) + "]")
#: Entries of the cache of a worker process; it is emptied beyond.
CACHE_ENTRIES = 600_000
#: A pre-token enters the cache when it comes for the second time, by a table of so many marks (a false mark only lets it in early).
MARKS = 1 << 22


def _char_class(kind: str) -> str:
    """A regex class body of the characters below ``LAST`` of a major category."""
    return "".join(re.escape(chr(c)) for c in range(LAST) if unicodedata.category(chr(c))[0] == kind)


def _patterns() -> dict[str, re.Pattern]:
    letter, number = _char_class("L"), _char_class("N")
    # The pre-token patterns of the two public vocabularies.
    word = rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+"
    byte = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"
    return {"word": re.compile(word), "byte": re.compile(byte)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = {k: v for k, v in json.load(f).items() if k != "model"}
        pre = json.dumps(spec.get("pre_tokenizer") or {})
        lowers = "Lowercase" in json.dumps(spec.get("normalizer") or {})
        known = _patterns()
        self.fold = lowers
        self.pattern = None
        if lowers and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pre:
            self.pattern = known["word"]
        elif not spec.get("normalizer") and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and spec["pre_tokenizer"]["use_regex"]:
            self.pattern = known["byte"]
        self.cache: dict[str, bytes] = {}
        self.marks = bytearray(MARKS)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids by the library alone."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens, many to a call of the library.

        Pre-tokens with a leading blank stay apart when put in a row, the
        others when joined by line breaks (a pre-token of its own, or none
        where white space is dropped); white space goes one by one.
        """
        blank = [x for x in new if x[0] == " " and len(x) > 1 and not x[1:].isspace()]
        plain = [x for x in new if not x[0].isspace()]
        single, out = [x for x in new if x.isspace()], {}
        for some, glue, step in ((blank, "", 1), (plain, "\n", 1 if self.fold else 2)):
            for at in range(0, len(some), 1024):
                part = some[at : at + 1024]
                got = self.tokenizer.encode(glue.join(part), add_special_tokens=False)
                ids, of = np.array(got.ids, "<u4"), np.array([-1 if w is None else w for w in got.word_ids])
                if len(of) and of[-1] == step * (len(part) - 1):
                    at_word = np.arange(0, step * len(part), step)
                    for x, i, j in zip(part, np.searchsorted(of, at_word), np.searchsorted(of, at_word, "right")):
                        out[x] = ids[i:j].tobytes()
                else:
                    single += part
        for x, e in zip(single, self.tokenizer.encode_batch(single, add_special_tokens=False)):
            out[x] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if self.pattern is None:
            return self.whole(texts)
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
            self.marks = bytearray(MARKS)
        out: list[bytes | None] = [None] * len(texts)
        odd = [i for i, x in enumerate(texts) if _ODD.search(x)]
        for i, b in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = b
        cache, find = self.cache, self.pattern.findall
        split = {i: find(x.lower() if self.fold else x) for i, x in enumerate(texts) if out[i] is None}
        got = {i: list(map(cache.get, parts)) for i, parts in split.items()}
        holes = [i for i, ids in got.items() if None in ids]
        new = {w for i in holes for w, b in zip(split[i], got[i]) if b is None}
        fresh = self._learn(list(new)) if new else {}
        for i in holes:
            got[i] = [fresh[w] if b is None else b for w, b in zip(split[i], got[i])]
        marks = self.marks
        for w, b in fresh.items():
            at = hash(w) & (MARKS - 1)
            if marks[at]:
                cache[w] = b
            else:
                marks[at] = 1
        for i, ids in got.items():
            out[i] = b"".join(ids)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
