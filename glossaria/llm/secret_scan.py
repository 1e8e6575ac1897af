"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are runs of at least 16 key characters with a digit and a letter,
values of any length and characters that are assigned to a name with a secret
word (``PWD=x``, ``"api_key": "x"``, ``?token=x``, ``Bearer x``), and what is
between ``:`` and ``@host``. They may overlap; ``redact`` masks what any of
the judged secrets covers. A candidate's features are its length, character
transitions and classes, entropy, the part of it that dictionary words cover,
and how the words beside it and in its path went with secrets in the labelled
findings (log odds). The dictionary is the words that most documents have, counted
over all of them, ``DICTIONARY_WORDS`` at most. The forest is trained
(``pyspark.ml``) on labelled findings; their number is bounded by
``MAX_FINDINGS``, and only the model, whose size these bounds fix, is sent to
the tasks. The odds that a finding is trained with come from the other half of
the findings. Without findings of one's own, ``default_findings`` makes
labelled ones from rules for key formats, passwords and look-alikes (check
sums, identifiers, placeholders) among words of the documents.

Defined results: null or empty text has no candidates; a null path has no path
words; a null doc_id is kept; repeated rows give repeated findings; an empty
table gives an empty result; further columns are ignored by ``scan`` and kept
by ``redact``. Starts and lengths count characters.
"""

from __future__ import annotations

import math
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm import textkit as tk
from glossaria.llm.storage import discard, materialise

MAX_FINDINGS = 20_000
TREES, DEPTH = 24, 7
THRESHOLD = 0.5
REACH = 40
#: So many characters before a separator are searched for a name.
NAME = 60
MASK = "[SECRET]"
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
#: A separator and the value after it, to the closing quote or the end of the word; NAMED fits the text before.
VALUE = re.compile(r"""(?:[:=]=?>?[ \t]*|(?<=[Bb]earer)[ \t]+|(?<=BEARER)[ \t]+)(?:(["'`])(?=([^"'`\n]+)\1)|(?=([^\s"'`,;&<>()\[\]{}|:=][^\s"'`,;&<>()\[\]{}|]*)))""")
NAMED = re.compile(r"""(?:secret|token|passw|passphrase|pass|pwd|api|key|auth|bearer|credential|private|access)[\w.-]*["'`]?\]?[ \t]*$""", re.I)
USERINFO = re.compile(r""":(?=([^\s"'`<>@/]+)@[\w\[])""")
_BOTH = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.S)
#: Words of the dictionary, their least and greatest length.
DICTIONARY_WORDS, SHORTEST, LONGEST = 20_000, 4, 12
#: Findings that a neighbouring word must have for its odds to count.
MIN_SEEN = 4
# Names that values are given in made findings.
SECRET_NAMES = ("secret", "client_secret", "api_key", "apiKey", "API_KEY", "token", "access_token", "authToken", "password", "PASSWORD", "db_password", "passwd", "pwd", "passphrase", "private_key", "aws_secret_access_key", "credential", "Bearer", "SECRET_KEY", "ENCRYPTION_KEY", "webhook.secret", "accessKey")
OTHER_NAMES = ("sha", "sha1", "sha256", "md5", "digest", "checksum", "commit", "hash", "uuid", "guid", "etag", "id", "revision", "version", "integrity", "parent", "tree", "build", "ref", "image", "session_id", "trace", "request-id", "file", "path", "url", "class", "import")
SECRET_PATHS = ("src/app.py", "conf/prod.yml", ".env", "deploy/settings.py", "src1", "notes", "config/database.yml")
OTHER_PATHS = ("src1", "src/app.py", "notes", "test/fixtures/a.json", "docs/example.md", "package-lock.json", "vendor/modules.txt", "mock/data.csv")
FEATURES = ("length", "transitions", "digits", "hex", "upper", "symbols", "entropy", "dictionary", "distinct", "uuid", "quoted", "assigned", "near_most", "near_least", "path_most", "path_least", "before_host")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
Finding = tuple[str, str, str, "str | None", int]


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters in names, cut at case too."""
    return [w.lower() for w in _WORD.findall(text)]


def beside(before: str, after: str) -> set[str]:
    return set(words_of(before)[-4:]) | set(words_of(after)[:2])


def covered(text: str, dictionary: frozenset[str]) -> float:
    """The part of ``text`` that dictionary words cover, the longest at each place."""
    low, until, total = text.lower(), 0, 0
    for at in range(len(low) - SHORTEST + 1):
        for end in range(min(len(low), at + LONGEST), at + SHORTEST - 1, -1):
            if low[at:end] in dictionary:
                total += max(0, end - max(at, until))
                until = max(until, end)
                break
    return total / max(1, len(low))


def odds(rows: Iterable[tuple[set[str], int]]) -> dict[str, float]:
    """The log odds of words, from the word sets of labelled findings."""
    seen, of = Counter(), Counter()
    n = [0, 0]
    for words, label in rows:
        n[label] += 1
        for w in words:
            seen[w] += 1
            of[w] += label
    base = math.log((n[1] + 1) / (n[0] + 1))
    return {w: math.log((of[w] + 0.5) / (c - of[w] + 0.5)) - base for w, c in seen.items() if c >= MIN_SEEN}


@dataclass
class Model:
    """Trees as arrays (feature, threshold, left, right, share of secrets), and what the features need."""

    trees: list[tuple[np.ndarray, ...]]
    dictionary: frozenset[str]
    near: dict[str, float]
    paths: dict[str, float]

    def features(self, candidate: str, before: str, after: str, path: str | None) -> list[float]:
        return features(candidate, before, after, path, self.dictionary, self.near, self.paths)


def features(candidate: str, before: str, after: str, path: str | None, dictionary: frozenset[str], near: dict[str, float], paths: dict[str, float]) -> list[float]:
    n = len(candidate)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in candidate]
    counts = Counter(candidate)
    lead = before.rstrip("\"'` ")
    by = [near[w] for w in beside(before, after) if w in near] or [0.0]
    where = [paths[w] for w in words_of(path or "") if w in paths] or [0.0]
    return [
        float(n),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        kinds.count("d") / n,
        sum(c in "0123456789abcdefABCDEF" for c in candidate) / n,
        kinds.count("u") / n,
        kinds.count("s") / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        covered(candidate, dictionary),
        len(counts) / n,
        float(bool(_UUID.match(candidate))),
        float(before[-1:] in ('"', "'", "`") and before != ""),
        float(lead[-1:] in ("=", ":") and lead != ""),
        max(by),
        min(by),
        max(where),
        min(where),
        float(after[:1] == "@"),
    ]


def dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The words (a-z) that most documents have, ``most`` at most: all that are in so many documents or more."""
    words = docs.filter("text is not null").select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("w")).filter(F.length("w").between(SHORTEST, LONGEST))
    counts = materialise(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    # the least number of documents that ``most`` words or fewer reach: a pass narrows it to a 32nd
    low, high = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1
    while low < high:
        cuts = sorted({low + (high - low) * i // 32 for i in range(32)})
        reached = counts.agg(*[F.count_if(F.col("n") >= c) for c in cuts]).first()
        fits = [c for c, n in zip(cuts, reached) if n <= most]
        high = fits[0] if fits else high
        low = max([c + 1 for c in cuts if c < high and c not in fits], default=low)
    rows = counts.filter(F.col("n") >= low).collect()  # at most ``most``
    discard(counts)
    return [w for _, w in sorted((-r["n"], r["w"]) for r in rows)]


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates, in order."""
    found = {m.span() for m in CANDIDATE.finditer(text) if _BOTH.match(m.group())}
    for m in VALUE.finditer(text):
        if NAMED.search(text[max(0, m.start() - NAME) : m.start()]):
            start, end = m.span(2) if m.group(1) else m.span(3)
            # a full stop or colon ends the sentence, not the value
            end = start + len(text[start:end].rstrip(".:")) if not m.group(1) else end
            if end > start:
                found.add((start, end))
    found |= {m.span(1) for m in USERINFO.finditer(text)}
    return sorted(found)


def default_findings(words: list[str], n: int = 4000, seed: int = 7) -> list[Finding]:
    """(candidate, before, after, path, label) made by rule, half of them secrets; ``words`` are those around them."""
    r = random.Random(seed)
    words = list(words) or ["word", "name", "value", "text"]
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: r.choice(words)
    some = lambda k: " ".join(word() for _ in range(k))
    given = lambda name, quote: f"{some(3)} {name}{' ' if name == 'Bearer' else r.choice((' = ', '=', ': ', ' := '))}{quote}"
    keys = (lambda: pick(hexa, 40), lambda: pick(hexa, 32), lambda: pick(hexa, 64), lambda: "AKIA" + pick(alnum[:26] + alnum[52:], 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 48), lambda: "AIza" + pick(alnum + "-_", 35), lambda: pick(alnum + "+/", 40), lambda: "xoxb-" + pick(alnum[52:], 12) + "-" + pick(alnum, 24), lambda: f"eyJ{pick(alnum, 30)}.{pick(alnum + '-_', 60)}")
    passwords = (lambda: pick(alnum, r.randint(7, 15)), lambda: pick(alnum[:52], r.randint(10, 32)), lambda: pick(alnum + "!#$%^*?+", r.randint(7, 20)), lambda: word() + pick("0123456789", r.randint(1, 4)) + pick("!#$%?xyz", r.randint(0, 3)), lambda: word().title() + r.choice("!#-_") + word() + pick("0123456789", 2))
    names = (lambda: "_".join(word() for _ in range(4)) + pick("0123456789", 2), lambda: "/".join(word() for _ in range(4)) + "/" + pick("0123456789", 4), lambda: word() + "-" + pick("0123456789", 4) + "-" + word() + "-" + pick("0123456789", 6), lambda: "".join(word().title() for _ in range(4)) + pick("0123456789", 1))
    plain = (word, lambda: word() + r.choice("_-. ") + word(), lambda: r.choice(("true", "false", "null", "none", "None", "required", "$", "*", "os.environ", "the", "a", "is", "1", "12", "${TOKEN}", "<password>", "changeme", "xxxxxxxx")), lambda: pick("0123456789", r.randint(1, 4)), lambda: "*" * r.randint(3, 12), lambda: "YOUR_API_KEY_HERE_" + pick("0123456789", 3))
    sums = (lambda: str(uuid.UUID(int=r.getrandbits(128))), lambda: pick(hexa, 40), lambda: pick(hexa, 64), lambda: pick(hexa, 32), lambda: "sha512-" + pick(alnum + "+/", 86))
    # either kind is found in either kind of file, only not as often
    path_of = lambda label: r.choice(SECRET_PATHS if (r.random() < 0.65) == bool(label) else OTHER_PATHS)
    out: list[Finding] = []
    for i in range(n):
        quote = r.choice(('"', "'", ""))
        tail = quote + " " + some(2)
        if i % 2:
            path = path_of(1)
            if i % 8 == 1 and i % 16 == 1:
                out.append((r.choice(passwords)(), f"{some(2)} {r.choice(('https', 'postgres', 'ftp'))}://{word()}:", f"@{word()}.example.org/{word()}", path, 1))
            elif i % 8 < 4:
                out.append((r.choice(passwords)(), given(r.choice(SECRET_NAMES), quote), tail, path, 1))
            else:
                out.append((r.choice(keys)(), given(r.choice(SECRET_NAMES), quote), tail, path, 1))
        elif i % 16 == 0:
            out.append((word(), f"{some(3)} mailto:", f"@{word()}.example.org {word()}", path_of(0), 0))
        elif i % 8 == 0:
            out.append((r.choice(plain)(), given(r.choice(SECRET_NAMES), quote), tail, path_of(0), 0))
        else:
            name = r.choice((*OTHER_NAMES, word()))
            out.append((r.choice(r.choice((sums, names)))(), f"{some(3)} {name}{r.choice((' ', ': ', ' = ', '-'))}{quote}", tail, path_of(0), 0))
    return out


def train_forest(spark: SparkSession, findings: list[Finding], words: Iterable[str] = (), seed: int = 11) -> Model:
    """The model of labelled findings, with the dictionary ``words``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    if len(findings) > MAX_FINDINGS:
        raise ValueError(f"more than {MAX_FINDINGS} labelled findings")
    known = frozenset(words)
    order = list(range(len(findings)))
    random.Random(seed).shuffle(order)
    halves = [set(order[::2]), set(order[1::2])]

    def tables(part: Iterable[int]) -> tuple[dict[str, float], dict[str, float]]:
        part = list(part)
        return odds((beside(findings[i][1], findings[i][2]), findings[i][4]) for i in part), odds((set(words_of(findings[i][3] or "")), findings[i][4]) for i in part)

    other = [tables(halves[1]), tables(halves[0])]
    rows = [(float(label), Vectors.dense(features(c, b, a, p, known, *other[i not in halves[0]]))) for i, (c, b, a, p, label) in enumerate(findings)]
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(spark.createDataFrame(rows, ["label", "features"]).coalesce(1))
    trees = []
    for tree in model.trees:
        nodes: list[list] = []

        def walk(node) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, 0.0])
            if node.subtreeDepth() > 0:
                split = node.split()
                nodes[at][0], nodes[at][1] = split.featureIndex(), split.threshold()
                nodes[at][2] = walk(node.leftChild())
                nodes[at][3] = walk(node.rightChild())
            else:
                stats = list(node.impurityStats().stats())
                nodes[at][4] = stats[1] / max(1e-9, sum(stats))
            return at

        walk(tree._call_java("rootNode"))
        f, t, left, right, p = zip(*nodes)
        trees.append((np.array(f), np.array(t), np.array(left), np.array(right), np.array(p)))
    return Model(trees, known, *tables(range(len(findings))))


def fitted(docs: DataFrame, findings: list[Finding] | None = None) -> Model:
    """The model for ``docs``: their dictionary, and made findings if there are none of one's own."""
    words = dictionary(docs)
    return train_forest(docs.sparkSession, default_findings(words) if findings is None else findings, words)


def forest_scores(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for f, t, left, right, p in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            inner = f[at] >= 0
            go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += p[at]
    return total / max(1, len(trees))


def _found(texts: list[str | None], paths: list[str | None], model: Model) -> tuple[list[tuple[int, int, int, str]], np.ndarray]:
    hits, x = [], []
    for i, (text, path) in enumerate(zip(texts, paths)):
        if not text:
            continue
        for start, end in candidates(text):
            s = text[start:end]
            hits.append((i, start, len(s), s))
            x.append(model.features(s, text[max(0, start - REACH) : start], text[end : end + REACH], path))
    return hits, forest_scores(model.trees, np.array(x)) if x else np.zeros(0)


def scan(docs: DataFrame, model: Model, path: str = "source") -> DataFrame:
    """A row per candidate: doc_id, start, length, score, is_secret."""

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                hits, score = _found(batch.column(1).to_pylist(), batch.column(2).to_pylist(), model)
                ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array(score.round(6)), pa.array(score >= THRESHOLD)], names=["doc_id", "start", "length", "score", "is_secret"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(f"`{path}`").cast("string").alias("path"))
    return source.mapInArrow(run, "doc_id long, start long, length long, score double, is_secret boolean")


def redact(docs: DataFrame, model: Model, path: str = "source") -> DataFrame:
    """``docs`` with every secret replaced by ``MASK``; n_chars, if there, follows the text."""
    names = docs.columns
    at_text, at_path = names.index("text"), names.index(path)

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                texts = batch.column(at_text).to_pylist()
                hits, score = _found(texts, batch.column(at_path).to_pylist(), model)
                out, size = list(batch.columns), None
                spans: list[list[int]] = []
                for (i, start, n, _), s in zip(hits, score):
                    if s >= THRESHOLD:
                        if spans and spans[-1][0] == i and start < spans[-1][2]:
                            spans[-1][2] = max(spans[-1][2], start + n)
                        else:
                            spans.append([i, start, start + n])
                for i, start, end in reversed(spans):
                    texts[i] = texts[i][:start] + MASK + texts[i][end:]
                    size = True
                if size:
                    out[at_text] = pa.array(texts, out[at_text].type)
                    if "n_chars" in names:
                        k = names.index("n_chars")
                        changed = {h[0] for h, s in zip(hits, score) if s >= THRESHOLD}
                        old = out[k].to_pylist()
                        out[k] = pa.array([len(texts[i]) if i in changed and old[i] is not None else old[i] for i in range(len(old))], out[k].type)
                yield pa.RecordBatch.from_arrays(out, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
