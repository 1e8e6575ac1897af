"""Language identification against a plain re-computation, and hostile markup."""

import math
import random
import re
import time

import pytest

from glossaria.llm import langid

WORDS = {"en": "the of and to in that it was for on".split(), "de": "der die und das ist nicht mit auf ein".split(), "fr": "le la et les des une dans que pour".split()}


def buckets(text):
    b = [c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()]
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 20 for i in range(len(b) - 2)]


def brute(docs, pages):
    """(kind, id) -> (text_lang, lang, confidence)."""
    names = sorted({x[2] for x in docs if x[2] is not None and x[1] is not None})
    freq = {x: [0.5] * langid.BUCKETS for x in names}
    for _, text, lang, _ in docs:
        if lang is not None:
            for b in buckets(text):
                freq[lang][b] += 1
    logs = {x: [math.log(v / sum(t)) for v in t] for x, t in freq.items()}
    rows = [("document", i, src or "", None, text) for i, text, _, src in docs]
    for i, url, html in pages:
        m = re.search(r"://([^/?#]*)", url or "")
        said = re.search(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", html or "", re.I)
        plain = re.sub(r"(?is)<(script|style|nav|header|footer)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html or "")
        rows.append(("page", i, m[1].lower() if m else "", said[1].lower() if said else None, plain))
    judged = []
    for kind, i, host, said, text in rows:
        keys = buckets(text)
        scale = min(1.0, langid.EVIDENCE / max(1, len(keys)))
        ll = [sum(logs[x][b] for b in keys) * scale for x in names]
        ll = [round(v - max(ll), 6) for v in ll]
        vote = names[ll.index(max(ll))] if max(ll) > min(ll) else None
        parts = host.split(".")
        judged.append((kind, i, (("",), (parts[-1],), (".".join(parts[-2:]),), (host, "host")), said, ll, vote))
    out = {}
    for kind, i, levels, said, ll, vote in judged:
        others = [r for r in judged]
        post = []
        for n, x in enumerate(names):
            own = vote == x
            prior = 1 / len(names)
            for depth, weight in enumerate((langid.GLOBAL_PRIOR, langid.SUFFIX_PRIOR, langid.DOMAIN_PRIOR, langid.HOST_PRIOR)):
                same = [r[5] for r in others if r[2][depth] == levels[depth] and r[5] is not None]
                prior = (same.count(x) - own + weight * prior) / (len(same) - (vote is not None) + weight)
            saying = 1.0
            if said is not None:
                heard = [(r[3], r[5]) for r in others if r[3] is not None]
                kinds = {d for d, _ in heard} | {x}
                pseudo = {d: langid.DECLARED_PRIOR if d == x else langid.OTHER_PRIOR for d in kinds}
                saying = (heard.count((said, x)) - own + pseudo[said]) / (sum(v == x for _, v in heard) - own + sum(pseudo.values()))
            post.append(ll[n] + math.log(prior) + math.log(saying))
        top = max(post)
        sure = 1 / sum(math.exp(p - top) for p in post)
        out[kind, i] = (vote, names[post.index(top)] if sure > 1 / len(names) + 1e-6 else "und", sure)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_identify_equals_brute_force(spark, seed):
    r = random.Random(seed)
    say = lambda x, n: " ".join(r.choice(WORDS[x]) for _ in range(n))
    docs = [(i, say(x := r.choice(list(WORDS)), r.choice((1, 3, 30))), r.choice((x, x, None)), r.choice(("src0", "a.de", "b.a.de", None))) for i in range(40)]
    docs += [(90, None, "en", "src0"), (91, "", None, None)]
    pages = []
    for i in range(40):
        x = r.choice(list(WORDS))
        lang = r.choice((f"<html lang={x}>", "<html class='a' LANG = 'xx'>", "<html lang='de-AT'>", "<p>", "<html><lang='fr'>"))
        pages.append((i, r.choice((None, "http://h1.example.de/a", "https://H2.example.de?x", "http://c.fr/", "no url")), f"{lang}<nav>{say('en', 9)}</nav><!-- {say('fr', 4)} > --><p>{say(x, r.choice((0, 2, 25)))}"))
    pages += [(80, "http://h1.example.de/", None), (81, None, "")]
    got = langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = brute(docs, pages)
    assert len(got) == len(want)
    for x in got:
        vote, lang, sure = want[x["kind"], x["doc_id"] if x["kind"] == "document" else x["page_id"]]
        assert (x["text_lang"], x["confidence"]) == (vote, pytest.approx(sure, abs=2e-5))
        assert x["lang"] == lang and x["kept"] == (lang != "und" and x["confidence"] >= 0.5)


def test_declarations_sum_to_one_for_each_language(spark):
    """The shares of all declarations given a language, from fused rows without text or address evidence."""
    said = ["aa", "bb", "xx"]
    rows = [(i, "h", said[i % 3], [0.0, -1.0 - (i % 2)]) for i in range(9)] + [(100 + j, "h", d, [0.0, 0.0]) for j, d in enumerate(said)]
    out = {x["id"]: x["_post"] for x in langid.fuse(spark.createDataFrame(rows, "id int, host string, declared string, ll array<double>"), ["aa", "bb"]).collect()}
    none = langid.fuse(spark.createDataFrame([*rows, (200, "h", None, [0.0, 0.0])], "id int, host string, declared string, ll array<double>"), ["aa", "bb"]).filter("id = 200").first()["_post"]
    assert [sum(math.exp(out[100 + j][i] - none[i]) for j in range(3)) for i in range(2)] == pytest.approx([1, 1])


def test_visible_text_is_that_of_the_pattern_and_takes_linear_time():
    pattern = re.compile(r"<(script|style|nav|header|footer)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    r = random.Random(5)
    bits = ["<nav>", "</nav>", "</NAV >", "<navy>", "<script x='1'", ">", "<!--", "-->", "<", "a", " b\n", "<p>", "</style>", "<style>", "<footer/>", "</footer"]
    for _ in range(3000):
        html = "".join(r.choice(bits) for _ in range(r.randrange(12)))
        assert langid.visible(html) == pattern.sub(" ", html), html
    began = time.time()
    for piece in ("<nav>", "<!--", "<nav", "</nav   ", "<script><!--"):
        langid.visible(piece * 100_000)
    assert time.time() - began < 20
