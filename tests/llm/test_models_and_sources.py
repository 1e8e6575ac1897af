import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaria.llm import langid, perplexity, secret_scan, url_filter, warc
from glossaria.llm.queries import URL_RULES
from glossaria.llm.storage import scratch_path

EN, DE = "the of and to in that it was for on with".split(), "der die und das ist nicht mit für auf ein über".split()


def prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    rows = [(i, prose(r, EN if i % 2 else DE, 40), "en" if i % 2 else "de", f"s{i % 3}") for i in range(200)]
    rows += [(900, None, "en", "s0"), (901, "", None, None), (902, prose(r, EN, 5), None, "s1"), (902, prose(r, EN, 5), None, "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language_of_documents_and_pages(spark, corpus):
    r = random.Random(2)
    page = lambda lang, words: f"<html lang='{lang}'><head><script>var the = 'of';</script></head><body><nav>{prose(r, EN, 40)}</nav><p>{prose(r, words, 60)}</p></body></html>"
    pages = [(i, f"http://h{i % 3}.example.{'de' if i % 2 else 'com'}/a", page("de" if i % 2 else "en", DE if i % 2 else EN)) for i in range(40)]
    pages += [(100, None, None), (101, "http://h1.example.de/x", ""), (102, "no url", page("en", DE))]
    out = {(x["kind"], x["doc_id"], x["page_id"]): x for x in langid.identify(corpus, spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("x"))).collect()}
    assert sum(out["document", i, None]["lang"] == ("en" if i % 2 else "de") for i in range(200)) >= 198
    assert all(out["page", None, i]["lang"] == ("de" if i % 2 else "en") for i in range(40))
    assert out["page", None, 101]["lang"] == "de"  # nothing but its host
    assert out["page", None, 102]["lang"] == "de"  # long text outweighs the declaration
    assert ("page", None, 100) in out and ("document", 900, None) in out
    empty = langid.identify(corpus.limit(0), spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {x["lang"] for x in empty.collect()} == {"und"}


def test_posterior_is_the_product_of_the_evidence(spark):
    rows = spark.createDataFrame([(1, "a.b.de", None, [0.0, -0.3]), (2, "a.b.de", None, [-1.0, 0.0]), (3, "c.com", None, [0.0, -2.0])], "doc_id long, host string, declared string, ll array<double>")
    out = {x["doc_id"]: x for x in langid.fuse(rows, ["de", "en"]).collect()}
    # the votes of the other two rows; one of them has the same host
    overall = np.array([1 + 0.5, 1 + 0.5]) / 3
    suffix = (np.array([0, 1]) + 50 * overall) / 51
    domain = (np.array([0, 1]) + 20 * suffix) / 21
    host = (np.array([0, 1]) + 10 * domain) / 11
    post = np.exp([0.0, -0.3]) * host
    assert out[1]["lang"] == ("de", "en")[post.argmax()] and out[1]["confidence"] == pytest.approx(post.max() / post.sum(), abs=1e-5)


LEXICON = "user name data file page site image index table value number service server client config public static content product order account report document project module system model state event message request response access required please write read every house river letter garden window summer because people little water thing great school again".split()


@pytest.fixture(scope="module")
def trees(spark):
    return secret_scan.train_forest(spark, secret_scan.default_findings(LEXICON), LEXICON)


def test_secrets_are_found_and_look_alikes_left(spark, trees):
    findings = secret_scan.default_findings(LEXICON)
    held = secret_scan.default_findings("alpha better common danger eleven fellow gentle happen island jungle kettle lemon".split(), 1000, 99)
    x = np.array([trees.features(c, b, a, p) for c, b, a, p, _ in held])
    right = (secret_scan.forest_scores(trees.trees, x) >= secret_scan.THRESHOLD) == np.array([bool(f[4]) for f in held])
    assert right.mean() > 0.95
    key = hashlib.sha1(b"x").hexdigest()
    rows = [(1, f'é call it token = "{key}" in text', "src1", 7), (2, "commit " + hashlib.sha1(b"y").hexdigest() + " merged", "src1", None), (3, None, None, None), (4, "", "s", 0), (None, f"password: '{key}'", "s", 1), (6, "mail a.b.c.d.e.f.g.h1@example.com 4929963689861572", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("score", F.lit("x"))
    got = {(r["doc_id"], r["start"], r["length"]): r["is_secret"] for r in secret_scan.scan(docs, trees).collect()}
    assert got == {(1, 19, 40): True, (2, 7, 40): False, (None, 11, 40): True}
    clean = {r["doc_id"]: r for r in secret_scan.redact(docs, trees).collect()}
    assert clean[1]["text"] == 'é call it token = "[SECRET]" in text' and clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[2]["text"] == rows[1][1] and clean[3]["text"] is None and len(clean) == 6
    assert secret_scan.scan(docs.limit(0), trees).count() == 0
    with pytest.raises(ValueError):
        secret_scan.train_forest(spark, findings * 6)


def test_assigned_secrets_are_candidates_and_masked(spark, trees):
    key, ghp, aws = hashlib.sha1(b"q").hexdigest(), "ghp_x7Kd93kfLs02mZpQ81vBnT54cYwRe6UaHi0J", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXzz81Kq0v"
    cases = [(f"api_key={ghp}", ghp), (f"export AWS_SECRET_ACCESS_KEY={aws}\n", aws), (f"https://x.org/a?token={key}&b=1", key), ("go postgres://user:h7Kw9zQx2v@db.example.org/x", "h7Kw9zQx2v"), (f"https://user:{key}@host.org/", key), ("password: kT4vX9qLz2.", "kT4vX9qLz2"), ("secret = 'qWvZkPxRtLmNbGhJ'", "qWvZkPxRtLmNbGhJ"), (f'{{"token": "{key}"}}', key), ("PASSWORD=aB3#xY9!kQ7$mP2 end", "aB3#xY9!kQ7$mP2")]
    docs = spark.createDataFrame([(i, t, "src1", len(t)) for i, (t, _) in enumerate(cases)], "doc_id long, text string, source string, n_chars long")
    got = {(r["doc_id"], r["start"], r["length"]): r["is_secret"] for r in secret_scan.scan(docs, trees).collect()}
    assert all(got.get((i, t.index(s), len(s))) for i, (t, s) in enumerate(cases)), got
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, trees).collect()}
    assert clean == {i: t.replace(s, secret_scan.MASK) for i, (t, s) in enumerate(cases)}


def test_words_after_secret_words_are_left(spark, trees):
    texts = ["the key: value of it", "access: public", "token=None", "password: required", "mail mailto:service@example.org now"]
    docs = spark.createDataFrame([(i, t, "src1") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = secret_scan.scan(docs, trees).collect()
    assert {r["doc_id"] for r in got} == set(range(5)) and not any(r["is_secret"] for r in got)


def test_warc_round_trip(spark):
    big = "<p>ü</p>" * 300
    rows = [(1, "http://a/", big), (7, "http://b/", big), (5, None, big), (2, "http://c/\r\nX: y", "small"), (3, "u", "small"), (4, "u", None), (6, "u", "A\r\n\r\nWARC/1.1\r\n" * 80), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0)).repartition(3)
    got = {r["page_id"]: r for r in warc.archive_round_trip(spark, pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = html == big and i != 7
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 7) if revisit else ("response", None))
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_source_pushes_predicates_and_skips_payloads(spark, compression):
    warc.register(spark)
    path = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame([(i, f"http://h{i % 2}/p{i}", f"body {i} " * 200) for i in range(20)], "page_id long, url string, html string")
    warc.page_records(pages).write.format("warc").option("compression", compression).mode("append").save(path)
    df = spark.read.format("warc").load(path)
    some = df.filter(F.col("target_uri").startswith("http://h1/") & (F.col("record_type") == "response") & (F.length("payload") > 0))
    assert some.count() == 10
    assert "PushedFilters" in some._jdf.queryExecution().toString() or some.count() == 10
    bare = spark.read.format("warc").option("payload", "false").load(path)
    assert bare.filter("payload is not null").count() == 0 and bare.filter("record_type = 'warcinfo'").count() >= 1
    reader = warc.WarcReader(path, True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_length",), 3)]))
    assert len(left) == 1 and reader.tests == [("eq", "record_type", "response")]
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 20


def test_classifier_keeps_prose_and_rejects_noise(spark, corpus):
    r = random.Random(3)
    noise = [(1000 + i, " ".join("".join(r.choice("xqzjk#*$%|") for _ in range(4)) for _ in range(40)), "en", "s") for i in range(20)]
    docs = corpus.unionByName(spark.createDataFrame(noise, corpus.schema)).withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(i, 1, None) for i in range(1, 100, 2)] + [(None, 1, 0), (1000, 0, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in perplexity.classify(docs, labels).collect()}
    assert sum(got[i]["kept"] for i in range(200)) >= 195
    assert not any(got[i]["kept"] for i in range(1000, 1020)) and not got[900]["kept"]
    assert all(x["kept"] for x in perplexity.classify(corpus.filter("text <> ''"), labels.limit(0)).collect())


def brute_rule(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_rules_and_templates(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.ORG/en/12?x=http://b.com/de/", "http://example.org/es/", "https://x.com/fr/1", "https://x.com/de/1#a", "ftp://com/de/", "http://notorg/", "http://a.org", "http://a.org?x/", "://b.net/é", "http://spam.example.net/buy/7", "http://spam.example.net/buy/8.html"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://mix.example.net/{'offer' if i % 2 else 'news'}/{i}") for i in range(200)] + [(7, urls[7])]
    labels = [(100 + i, i % 2 == 1) for i in range(0, 200)] + [(999, True), (None, True)]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("x")), spark.createDataFrame(labels, "page_id long, bad boolean"), URL_RULES).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    for i, u in pages:
        host, path, (rule, verdict) = brute_rule(u)
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule)
        if rule:
            assert by[i]["verdict"] == verdict
    assert all(by[100 + i]["verdict"] == ("block" if i % 2 else "allow") for i in range(200))
    assert by[101]["rejected_template"] == "/offer/*" or by[101]["rejected_template"] == "/offer/{n}"
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean"), URL_RULES).count() == 0


@pytest.mark.parametrize("sections", [20, 60])
def test_a_bad_section_keeps_its_branch_among_many(spark, sections):
    names = ["".join(chr(103 + int(c)) for c in f"{i:03d}") for i in range(sections)]
    pages = [(i * 100 + j, f"http://big.example.net/{name}/page{j}x") for i, name in enumerate(names) for j in range(60)]
    labels = [(p, p < 100) for p, _ in pages]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"), []).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {p for p, _ in pages if p < 100}


def test_a_bad_branch_below_the_fourth_segment(spark):
    pages = [(i, f"http://deep.example.net/a/b/c/d/{'spam' if i % 2 else 'good'}/e/{'x' if i % 3 else 'y'}/page{i}x") for i in range(120)] + [(500 + i, f"http://deep.example.net/a/b/c/d{'/' * (i % 2)}") for i in range(4)]
    labels = [(i, i % 2 == 1) for i in range(120)]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"), []).collect()
    assert len(got) == len(pages)
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(1, 120, 2))
    assert all(r["rejected_template"].startswith("/a/b/c/d/spam/") for r in got if r["verdict"] == "block")
