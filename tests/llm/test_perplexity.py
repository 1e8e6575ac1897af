"""Perplexities, cutoffs and verdicts against the model from its definition."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, fold

from glossaria.llm import perplexity as px
from glossaria.llm import textkit as tk

DOC = "doc_id long, text string, lang string"
LABEL = "doc_id long, quality int, toxic int"


def bucket(word):
    data, off = tk.utf8(pa.array([word], pa.string()))
    return int(tk.range_hashes(data, off[:1], off[1:], fold=True)[0] >> np.uint64(64 - px.BITS))


def pairs(text, cache={}):
    words = [cache.setdefault(w, bucket(w)) if w not in cache else cache[w] for w in WORD.findall(fold(text or ""))]
    return list(zip([px.EDGE, *words], words))


def discounts(counts):
    n = [sum(v == i for v in counts) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    d = [min(i - 0.1, max(0.1, i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i)) for i in (1, 2, 3)]
    return lambda c: d[min(c, 3) - 1]


def model(texts):
    """P(word | previous word) by interpolated modified Kneser-Ney."""
    bi = Counter(p for t in texts for p in pairs(t))
    types = Counter(w for _, w in bi)
    cut2, cut1 = discounts(bi.values()), discounts(types.values())
    all_ = sum(types.values())
    spare = sum(cut1(c) for c in types.values()) / all_ if types else 1.0
    contexts = {}
    for (v, _), c in bi.items():
        contexts.setdefault(v, []).append(c)

    def prob(v, w):
        low = ((types[w] - cut1(types[w])) / all_ if types[w] else 0.0) + spare / 2**px.BITS
        if v not in contexts:
            return low
        total = sum(contexts[v])
        own = (bi[v, w] - cut2(bi[v, w])) / total if bi[v, w] else 0.0
        return own + sum(map(cut2, contexts[v])) / total * low

    return prob, contexts, types


def made(r, n):
    words = ["the", "of", "The", "and", *[f"w{i}" for i in range(60)]]
    text = lambda k: r.choice((" ", "\n")).join(r.choice(words[: r.choice((4, 20, 64))]) for _ in range(k))
    docs = [(i, text(r.choice((0, 1, 2, 15, 80))), r.choice(("en", "de"))) for i in range(n)]
    docs += [(900, None, "en"), (901, "  \n", None), (902, "new words only here", "xx"), (902, "new words only here", "xx"), (3, "of the", "en"), (None, "the of", "en")]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(n)] + [(5, 1, 0), (None, 1, 0)]
    return docs, labels


@pytest.mark.parametrize("shard, block, piece", [(16_000_000, 4096, 4_000_000), (300, 16, 200)])
def test_classify_equals_brute_force(spark, monkeypatch, shard, block, piece):
    """The second case cuts the entries into many slices, blocks and shards, so that frequent contexts span shards."""
    for name, value in (("SHARD", shard), ("BLOCK", block), ("SLICE", piece)):
        monkeypatch.setattr(px, name, value)
    docs, labels = made(random.Random(shard), 150)
    trusted = {i for i, q, t in labels if q == 1 and t == 0 and i is not None}
    held = {r["i"] for r in spark.createDataFrame([(i,) for i in trusted], "i long").filter("pmod(xxhash64(i, 29), 4) = 0").collect()}
    prob, contexts, types = model([t for i, t, _ in docs if i in trusted - held])
    nats = [-sum(math.log(prob(v, w)) for v, w in pairs(t)) for _, t, _ in docs]
    size = [len(pairs(t)) for _, t, _ in docs]
    known = [k for k, (i, _, _) in enumerate(docs) if i in held and size[k]]
    mean = sum(nats[k] for k in known) / sum(size[k] for k in known)
    score = [math.exp((x + px.STEADY * mean) / (n + px.STEADY)) if n else None for x, n in zip(nats, size)]

    def cut(some):
        some = sorted(some)
        return some[max(0, math.ceil(0.9 * len(some)) - 1)] if some else None

    by = {x: cut([score[k] for k in known if (docs[k][2] or "") == x]) for x in ("en", "de", "xx", "")}
    overall = cut([score[k] for k in known])
    got = px.classify(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(labels, LABEL), 0.9).collect()
    assert len(got) == len(docs)
    order = lambda i, n, p: (i is None, i or 0, n, p or 0)
    want = sorted(((i, x or "", n, s, by[x or ""] or overall) for (i, _, x), n, s in zip(docs, size, score)), key=lambda w: order(w[0], w[2], w[3]))
    for x, (i, lang, n, s, c) in zip(sorted(got, key=lambda x: order(x["doc_id"], x["n_words"], x["perplexity"])), want):
        assert (x["doc_id"], x["lang"], x["n_words"]) == (i, lang, n)
        assert x["cutoff"] == pytest.approx(c, rel=1e-4) and (x["perplexity"] is None if s is None else x["perplexity"] == pytest.approx(s, rel=1e-4))
        assert x["kept"] == (s is not None and x["perplexity"] <= x["cutoff"])


def test_probabilities_sum_to_one():
    docs, labels = made(random.Random(2), 60)
    prob, contexts, types = model([t for _, t, _ in docs])
    rest = 2**px.BITS - len(types)
    unseen = next(i for i in range(1, 10**6) if i not in types)
    for v in [*list(contexts)[:20], unseen]:
        assert sum(prob(v, w) for w in types) + rest * prob(v, unseen) == pytest.approx(1)


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for n in (1, 2, 500):
        entry = np.sort(r.integers(0, 1 << 60, n).astype(np.uint64))
        count = r.integers(1, 2**31, n)
        a, b = px.unpack(px.pack(entry, count))
        assert (a == entry).all() and (b == count).all()


def test_order_of_words_counts(spark):
    """Word salad of trusted words is rejected; sentences of the same words in trusted order are not."""
    r = random.Random(6)
    chain = {w: [f"{w}{x}" for x in "ab"] for w in "pqrstu"}
    nxt = dict(zip("pqrstu", "qrstup"))

    def sentence(n):
        out, at = [], r.choice("pqrstu")
        for _ in range(n):
            out.append(r.choice(chain[at]))
            at = nxt[at]
        return out

    docs = [(i, " ".join(sentence(60)), "en") for i in range(300)]
    for i in range(40):
        words = sentence(60)
        r.shuffle(words)
        docs.append((1000 + i, " ".join(words), "en"))
    labels = [(i, 1, 0) for i in range(250)]
    got = {x["doc_id"]: x["kept"] for x in px.classify(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)).collect()}
    assert sum(got[i] for i in range(250, 300)) >= 48 and not any(got[1000 + i] for i in range(40))
