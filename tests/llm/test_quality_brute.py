"""Cutoffs and verdicts of the quality rules against a plain re-computation."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from brute import text_counts

from glossaria.llm import quality_rules as qr

DOC = "doc_id long, text string, lang string"
LABEL = "doc_id long, quality int, toxic int"


def upper(k, n, level):
    """The largest p with P(X <= k) >= level, by bisection on exact sums."""
    if k >= n:
        return 1.0
    tail = lambda p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    low, high = 0.0, 1.0
    for _ in range(80):
        p = (low + high) / 2
        low, high = (p, high) if tail(p) > level else (low, p)
    return low


def score_of(text):
    n, chars, symbols, dup, repeat = text_counts(text)
    lines = sum(bool(x.split()) for x in (text or "").split("\n"))
    length = chars / n if n else 0.0
    return {"repeat_share": repeat / n if n else 0.0, "symbol_share": symbols / chars if chars else 0.0, "dup_line_share": dup / lines if lines else 0.0, "word_length": length, "word_shortness": -length}


def brute(spark, docs, labels, alpha, delta):
    """doc index -> (kept, failed rules); the halves and units are read from the operator's statistics."""
    base = [(n := text_counts(t))[0] < 20 or 100 * n[4] > 30 * n[0] for _, t, _ in docs]
    units = []
    for _, t, _ in docs:
        data = np.frombuffer((t or "").encode(), np.uint8)
        units.append(int(qr.text_stats(data, np.array([0, len(data)]))["unit"][0]))
    halves = {r["u"]: r["d"] for r in spark.createDataFrame([(u,) for u in set(units)], "u long").selectExpr("u", "pmod(xxhash64(u, 17), 2) = 0 AS d").collect()}
    scores = [score_of(t) for _, t, _ in docs]
    quality = {i: q for i, q, _ in labels if q is not None and i is not None}
    strata = {x or "" for _, _, x in docs}
    proposals, tests = {}, {}
    for x in strata:
        rows = [k for k, (i, _, lang) in enumerate(docs) if (lang or "") == x and not base[k] and i in quality]
        design = [k for k in rows if halves[units[k]]]
        good, bad = [k for k in design if quality[docs[k][0]]], [k for k in design if not quality[docs[k][0]]]
        found = []
        for rule, grid in qr.GRID.items():
            best = None
            for c in grid:
                hit, share = sum(scores[k][rule] > c for k in bad), sum(scores[k][rule] > c for k in good) / max(1, len(good))
                if hit >= qr.MIN_BAD and share <= alpha / 2 and hit / max(1, len(bad)) >= qr.MIN_LIFT * share and (best is None or hit > best[1]):
                    best = (share, hit, rule, c)
            if best:
                found.append(best)
        if found:
            proposals[x] = [(rule, c) for _, _, rule, c in sorted(found, key=lambda f: (f[0], -f[1], f[2]))]
            held = {}
            for k in rows:
                if not halves[units[k]] and quality[docs[k][0]]:
                    first = next((r for r, (rule, c) in enumerate(proposals[x]) if scores[k][rule] > c), len(proposals[x]))
                    held[units[k]] = min(first, held.get(units[k], first))
            tests[x] = [(len(held), sum(f <= r for f in held.values())) for r in range(len(proposals[x]))]
    certified = {x: [p for p, (n, k) in zip(proposals[x], tests[x]) if n and upper(k, n, delta / len(proposals)) <= alpha] for x in proposals}
    out = []
    for k, (_, _, lang) in enumerate(docs):
        failed = [rule for rule in qr.GRID if any(rule == r and scores[k][r] > c for r, c in certified.get(lang or "", []))]
        out.append((not base[k] and not failed, ",".join(failed)))
    return out, certified


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_equal_brute_force(spark, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        lang = r.choice(("en", "en", "de", None))
        words = [r.choice(("alpha", "be", "gamma", "delta")) + str(r.randrange(9999)) for _ in range(30)]
        if bad and lang != "de":
            words = [w + "#" * r.choice((0, 2, 9)) for w in words] if i % 2 else words + ["w" * 60] * 3
        text = r.choice((" ", "\n")).join(words) if i % 50 else r.choice((None, "", "few words"))
        docs.append((i, text, lang))
        labels.append((i, int(not bad) if r.random() < 0.95 else None, 0))
        if i % 7 == 0:
            docs.append((10_000 + i, text, lang))  # copies are one unit
            labels.append((10_000 + i, int(not bad), 0))
    docs.append(docs[3])
    alpha, delta = 0.05, 0.2
    want, certified = brute(spark, docs, labels, alpha, delta)
    got = qr.quality_verdicts(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), alpha=alpha, delta=delta).collect()
    assert Counter((x["doc_id"], x["kept"], x["failed_rules"]) for x in got) == Counter((d[0], k, f) for d, (k, f) in zip(docs, want))
    assert any(certified.values()) and any(f for _, f in want)
