"""Plain re-computations of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, k: int) -> set:
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    seen = Counter()
    for ids in by.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                seen[a, b] += 1
    for (a, b), both in seen.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def contained(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], k: int, percent: int) -> set[tuple[int, int, int, int]]:
    """(doc_id, item_id, shingles of the item, of these in the document)."""

    def runs(text):
        w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    known = [(i, runs(t)) for i, t in items]
    out = set()
    for d, t in docs:
        have = runs(t)
        out |= {(d, i, len(s), len(s & have)) for i, s in known if s and 100 * len(s & have) >= percent * len(s)}
    return out
