import random
import zlib

import numpy as np
import pytest
from brute import components, contained, shingles, text_counts
from pyspark.sql import functions as F

from glossaria.llm import decontaminate, near_dedup, packing, quality_rules, token_codes
from glossaria.llm.queries import vocabulary
from glossaria.llm.tokens import Encoder

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed: int, n: int = 160) -> list[tuple]:
    """Documents with exact and near copies, blanks, nulls and one hot group."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice((3, 12, 40, 120)))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(base[0 if i % 3 == 0 else r.randrange(len(base))])
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            words[r.randrange(len(words))] = r.choice(vocab)
        if r.random() < 0.3:
            words = [r.choice(vocab) for _ in range(60)]
        text = r.choice((" ", "  ", "\n")).join(words)
        rows.append((i, text.upper() if r.random() < 0.1 else text, r.choice(("en", "de")), "src0", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \n\t ", "en", "s", 4), (n + 3, None, "en", "s", None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = made(seed)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOC).withColumn("component", F.lit(1)).repartition(5), k=4, percent=80).collect()
    want = components([r[:2] for r in rows], 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_a_star(spark):
    """Copies that are near the original but often not near each other are one component."""
    r = random.Random(5)
    words = [f"x{i}" for i in range(200)]
    rows = [(1000, " ".join(words))]
    for i in range(300):
        w = list(words)
        for at in r.sample(range(200), 6):
            w[at] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in components(rows, 4, 80).items()}


def test_near_pairs_in_buckets_of_many_components(spark):
    """Members that never lead a bucket are linked as well, though their buckets' other members are too far."""
    r, rows = random.Random(12), []
    base = [f"w{i}" for i in range(400)]
    for i in range(400):
        at = r.sample(range(400), 13)
        for j, mine in ((0, at[:8]), (1, at[:3] + at[8:])):
            w = list(base)
            for x in mine:
                w[x] = f"y{i}_{x}"
            rows.append((2 * i + j, " ".join(w)))
    sets = [shingles(t, 4) for _, t in rows]
    ids = {x: n for n, x in enumerate(set().union(*sets))}
    has = np.zeros((len(sets), len(ids)), np.float32)
    for n, s in enumerate(sets):
        has[n, [ids[x] for x in s]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    near = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    want = np.arange(len(sets))
    while (low := np.where(near, want[None, :], len(sets)).min(axis=1)).tolist() != want.tolist():
        want = low
    assert len(set(want.tolist())) > 300
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want.tolist()))


def test_deduplicate_keeps_one_row_and_all_columns(spark):
    rows = made(3, 60)
    docs = spark.createDataFrame(rows, DOC).withColumn("kept", F.lit("x"))
    out = near_dedup.deduplicate(docs, 4)
    assert out.columns == docs.columns
    want = components([r[:2] for r in rows], 4, 80)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(5, text), (5, text), (7, text), (None, text), (None, None), (9, "short one")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got if r["n_shingles"]) == [(-1, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_quality_counts_and_base_rule(spark):
    line = "one two three four five six seven eight nine ten\n"
    rows = made(4, 60) + [(500, line * 3, "en", "s", 1), (501, "é " * 25 + "# $%&|<>* a", "fr", "s", 1), (502, "a\n a\na\n\n\na", "en", "s", 1), (502, "a\n a\na\n\n\na", "en", "s", 1)]
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, None), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_verdicts(spark.createDataFrame(rows, DOC).withColumn("n_words", F.lit(0)), labels).collect()
    assert len(got) == len(rows)
    want = {r[0]: text_counts(r[1]) for r in rows}
    for r in got:
        n = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert r["kept"] == (not r["base_failed"])  # too few labels to certify a cutoff


def test_delta_is_divided_by_the_proposed_cutoffs(spark):
    """Strata without a proposal don't weaken the others' bounds."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(2400):
        bad = i % 4 == 0
        rows.append((i, " ".join(str(r.randrange(10**5, 10**6)) + ("###" if bad else "") for _ in range(30)), "en" if i < 2200 else f"l{i % 20}", "s", 0))
        labels.append((i, int(not bad or i >= 2200), 0))
    stats = quality_rules.with_stats(spark.createDataFrame(rows, DOC), keep=["doc_id", "lang"])
    got = quality_rules.certified_cutoffs(stats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "lang").collect()
    assert {x["stratum"] for x in got} == {"en"} and all(x["n_good"] < 1000 and x["bound"] <= 0.005 for x in got)


def test_certified_cutoffs_reject_only_the_bad(spark):
    r = random.Random(1)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows, labels = [], []
    for i in range(6000):
        bad = i % 4 == 0
        words = [r.choice(vocab) + str(r.randrange(1000)) + ("###" if bad and r.random() < 0.5 else "") for _ in range(30)]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not bad), 0))
    out = quality_rules.quality_filter(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {x["doc_id"] for x in out.collect()}
    good = [i for i in range(6000) if i % 4]
    assert sum(i not in kept for i in good) <= 0.01 * len(good)
    assert sum(i in kept for i in range(0, 6000, 4)) < 200


def test_binomial_bound_is_exact():
    from math import comb

    p = quality_rules.binomial_upper(3, 50, 0.01)
    assert sum(comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) == pytest.approx(0.01, rel=1e-6)
    assert quality_rules.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-6)
    assert quality_rules.binomial_upper(0, 0, 0.05) == 1.0


ODD = ["", " ", "a\n\n b  c", "it's 'S 's", "\t\ttab  \n", "日本 ＡＢ café", "ǆ Ǆ İ ß", "1²³ ½ ͅx", "<|endoftext|> <|startoftext|>", "a\x00b \xadx\x85y", "...,,, ''' !!", "x" * 5000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_equals_the_library(name):
    e = Encoder(vocabulary(name))
    low = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = ODD + low + [f"a{c}b {c} 7{c} X{c}Ye{c}" for c in low] + [r[1] or "" for r in made(9)]
    assert e.encode(texts) == e.whole(texts)
    assert e.encode(texts) == e.whole(texts)


def test_token_codes_round_trip(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*ODD, None, None])] + [(3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).repartition(4)
    got = token_codes.round_trip(spark, docs, vocabulary("word_bpe_49k.json"), 2).orderBy("start").collect()
    e, end = Encoder(vocabulary("word_bpe_49k.json")), np.array([2], "<u4").tobytes()
    want = sorted((i if i is not None else -1, len(b) // 4 + 1, zlib.crc32(b + end)) for (i, _), b in zip(rows, e.whole([t or "" for _, t in rows])))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_codes.round_trip(spark, docs.limit(0), vocabulary("word_bpe_49k.json"), 2).count() == 0


def test_random_access_to_any_token():
    r = np.random.default_rng(3)
    ids = np.concatenate([r.integers(0, 300, 3000), r.integers(0, 50_000, 3000), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    raw = token_codes.to_bytes(np.arange(3), np.array([0, 10, 20, len(ids)]), ids)
    code = token_codes.CodeFile(lambda o, n: raw[o : o + n], len(raw))
    assert (code.all() == ids).all()
    for i in [0, 1, 511, 512, 513, 2999, 3000, 5999, *range(6000, 6006), *r.integers(0, len(ids), 200).tolist()]:
        assert code.token(int(i)) == ids[i]


def test_best_fit_places_everything_once():
    r = random.Random(2)
    sizes = [(n, r.randrange(1, 60)) for n in range(1, 101)] + [(37, 4000)]
    counts = {}
    for n, c in sizes:
        counts[n] = counts.get(n, 0) + c
    places = packing.best_fit(counts.items(), 100)
    used: dict[int, list] = {}
    for size, a, b, first, offset in places:
        for k in range(b - a):
            used.setdefault(first + k, []).append((offset, size))
    assert {n: sum(b - a for s, a, b, _, _ in places if s == n) for n in counts} == counts
    for spans in used.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 100
    items = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    gaps: list[int] = []
    for n in items:  # one by one: best fit decreasing
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(100 - n)
        else:
            gaps[gaps.index(fit)] = fit - n
    assert len(used) == len(gaps)


def test_packing_of_documents(spark):
    rows = [(i, " ".join(f"w{j % 97}" for j in range(n))) for i, n in enumerate([0, 1, 5, 900, 2500, 40, 40, 40])] + [(99, None), (99, None), (None, "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("x")), vocabulary("byte_bpe_50k.json"), 2, 256).collect()
    e, end = Encoder(vocabulary("byte_bpe_50k.json")), np.array([2], "<u4").tobytes()
    want = []
    for i, t in rows:
        ids = e.whole([t or ""])[0] + end
        n = len(ids) // 4
        first = n if n <= 256 else (n % 256 or 256)
        cuts = [0, *range(first, n + 1, 256)]
        want += [(i or -1, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary("byte_bpe_50k.json"), 2, 256).count() == 0


def test_contained_items_equal_brute_force(spark):
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice((4, 5, 9, 30, 60))))) for i in range(30)] + [(90, None), (None, "a b c d e f"), (91, "")]
    docs = []
    for i in range(120):
        words = [r.choice(vocab) for _ in range(r.choice((6, 80, 900)))]
        if i % 3 == 0:
            part = items[r.randrange(30)][1].split()
            for _ in range(r.choice((0, 0, 1, 2))):
                part[r.randrange(len(part))] = "other"
            words[5:5] = [x.upper() + "," for x in part]
        docs.append((i, " ".join(words)))
    docs += [(400, None), (None, items[3][1]), (401, ""), (7, docs[7][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id long, text string"))
    want = contained([d for d in docs if d[0] is not None], [x for x in items if x[0] is not None], 5, 80)
    assert {tuple(x) for x in got.select("doc_id", "item_id", "n_item_shingles", "n_matched").collect()} == want and want
    left = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {x["doc_id"] for x in left.collect()} == {d for d, _ in docs} - {d for d, *_ in want}
