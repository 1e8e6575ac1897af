"""Quality rules with risk-controlled cutoffs.

A base rule (too few words, too many repeated 8-word windows) is fixed. The
other rules compare a score with a cutoff per stratum. Labelled rows are split
in two by the smallest hash of their 8-word windows, so copies of a text, and
near copies with a probability near their similarity, are in one half and one
unit of it. The design half proposes, per stratum, a cutoff for each rule and
an order of the rules. The holdout half tests the union of the first rule, of
the first two and so on, each by an exact (Clopper-Pearson) binomial upper
bound on the share of good units that any of them rejects, and stops at the
first union whose bound is above ``alpha`` (a fixed sequence needs no
correction). The level is ``delta`` divided by the number of strata with
proposals (Bonferroni), so with probability 1 - ``delta`` no stratum has more
than ``alpha`` of its good units rejected by all its rules together. Cutoffs
that can't be certified aren't used.

Defined results: null text has no words (base rule fails); null stratum is
stratum ``""``; rows without labels count only in the verdict; repeated ids
are rows of their own; an empty table gives an empty result; further columns
are ignored by :func:`quality_verdicts` and kept by :func:`quality_filter`,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm import textkit as tk
from glossaria.llm.storage import free_name, materialise

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ALPHA = 0.005
DELTA = 0.05
#: A proposed cutoff rejects so many bad rows of the design half at least, and so many times the share of good ones.
MIN_BAD, MIN_LIFT = 5, 5.0
#: Candidate cutoffs; a row is rejected if its score is larger.
GRID = {
    "repeat_share": [i / 100 for i in range(2, 31, 2)],
    "symbol_share": [i / 200 for i in range(1, 41, 2)],
    "dup_line_share": [i / 20 for i in range(1, 19)],
    "word_length": [6 + i / 2 for i in range(0, 19)],
    "word_shortness": [-5 + i / 4 for i in range(0, 15)],
}
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "unit")
PREFIX = "q"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def text_stats(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts in ``STATS`` for each row of a UTF-8 buffer."""
    w = tk.words(data, off)
    space = tk._SPACE[data]
    out = {"n_words": np.diff(w.first), "word_chars": tk.by_row(~space & ((data & 0xC0) != 0x80), off), "n_symbols": tk.by_row(_SYMBOL[data], off)}

    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1][off[:-1] < off[1:]], cuts + 1]))
    starts = starts[starts < len(data)]
    row = np.searchsorted(off, starts, "right") - 1
    ends = np.append(starts[1:], len(data))
    # a line that ends at \n leaves it out; the last line of a row has none
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10)) if len(starts) else ends
    filled = np.concatenate([[0], np.cumsum(~space)])
    has = filled[ends] > filled[starts]
    starts, ends, row = starts[has], ends[has], row[has]
    h = tk.range_hashes(data, starts, ends)
    order = np.lexsort((h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    n = len(off) - 1
    out["n_lines"] = np.bincount(row, minlength=n)
    out["n_dup_lines"] = np.bincount(row[order][1:][again], minlength=n)

    keys, at, rows = tk.windows(tk.range_hashes(data, w.starts, w.ends), w.first, WINDOW)
    unit = np.zeros(n, np.uint64)
    some = np.flatnonzero(np.diff(rows))
    if len(some):
        unit[some] = np.minimum.reduceat(keys, rows[:-1][some])
    out["unit"] = unit.view(np.int64)
    keys = keys ^ tk.mix64(tk.row_of(rows).astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.starts) + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = tk.by_row(np.cumsum(edge[:-1]) > 0, w.first)
    return out


def with_stats(df: DataFrame, keep: list[str] | None = None, prefix: str = PREFIX) -> DataFrame:
    """``df``'s columns ``keep`` (all if None) and the statistics of its texts, as ``prefix``_name."""
    keep = df.columns if keep is None else keep
    names = [f"{prefix}_{x}" for x in STATS]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(f"{prefix}_text"))
    at = len(keep)

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole, source_text):
                got = text_stats(*tk.utf8(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array(got[x].astype(np.int64)) for x in STATS)], names=[*batch.schema.names[:at], *names])

    source_text = f"{prefix}_text"
    schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    for x in names:
        schema = schema.add(x, "long")
    return source.mapInArrow(run, schema)


def _ratio(a: str, b: str):
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def scores(prefix: str = PREFIX) -> dict:
    """The score column of each rule; more is worse."""
    length = _ratio(f"{prefix}_word_chars", f"{prefix}_n_words")
    return {
        "repeat_share": _ratio(f"{prefix}_n_repeat_words", f"{prefix}_n_words"),
        "symbol_share": _ratio(f"{prefix}_n_symbols", f"{prefix}_word_chars"),
        "dup_line_share": _ratio(f"{prefix}_n_dup_lines", f"{prefix}_n_lines"),
        "word_length": length,
        "word_shortness": -length,
    }


def base_failed(prefix: str = PREFIX):
    return (F.col(f"{prefix}_n_words") < MIN_WORDS) | (100 * F.col(f"{prefix}_n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{prefix}_n_words"))


def binomial_upper(k: int, n: int, level: float) -> float:
    """The exact upper confidence bound of a share of which k of n were seen."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    choose = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i])
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = np.exp(choose + i * math.log(p) + (n - i) * math.log1p(-p)).sum() if p < 1 else 0.0
        low, high = (p, high) if tail > level else (low, p)
    return high


def _propose(pdf: pd.DataFrame, alpha: float) -> pd.DataFrame:
    """The cutoffs of a stratum, in the order of the tests: the least false rejection of the design half first."""
    found = []
    for rule, cutoffs in GRID.items():
        table = np.zeros((2, len(cutoffs) + 1), np.int64)
        own = pdf[pdf["rule"] == rule]
        np.add.at(table, (own["good"].astype(int).to_numpy(), own["bin"].astype(int).to_numpy()), own["n"].to_numpy())
        # rejected by cutoff i: rows in bins above i
        above, total = table[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:], table.sum(axis=1)
        best = None
        for i, cutoff in enumerate(cutoffs):
            bad, share = int(above[0, i]), above[1, i] / max(1, total[1])
            if bad >= MIN_BAD and share <= alpha / 2 and bad / max(1, total[0]) >= MIN_LIFT * share and (best is None or bad > best[1]):
                best = (share, bad, rule, cutoff)
        if best:
            found.append(best)
    found.sort(key=lambda x: (x[0], -x[1], x[2]))
    return pd.DataFrame([(pdf["stratum"].iloc[0], i + 1, rule, cutoff) for i, (_, _, rule, cutoff) in enumerate(found)], columns=["stratum", "rank", "rule", "cutoff"])


def _by_stratum(cutoffs: DataFrame, prefix: str) -> DataFrame:
    """A row for each stratum: the cutoff and rank of each rule."""
    of = lambda r, c: F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{prefix}_{c}_{r}")
    return cutoffs.groupBy(F.col("stratum").alias(f"{prefix}_stratum")).agg(*[of(r, c) for r in GRID for c in ("cutoff", "rank")])


def certified_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA, prefix: str = PREFIX) -> DataFrame:
    """Certified cutoffs: stratum, rank, rule, cutoff, n_good, n_false, bound.

    ``stats`` has doc_id, ``stratum`` and the statistics; ``labels`` has
    doc_id and quality (1 good, 0 bad, null ignored). n_good and n_false are
    units of the holdout half; n_false counts those that the rules up to this
    rank reject. Only counts by stratum, rule and bin leave the rows.
    """
    known = labels.select(F.col("doc_id").alias(f"{prefix}_id"), (F.col("quality") > 0).alias(f"{prefix}_good")).filter(f"{prefix}_good is not null")
    at = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit(""))
    design = (F.pmod(F.xxhash64(f"{prefix}_unit", F.lit(17)), F.lit(2)) == 0).alias(f"{prefix}_design")
    judged = stats.filter(~base_failed(prefix)).join(known, F.col("doc_id") == F.col(f"{prefix}_id")).select(at.alias("stratum"), design, F.col(f"{prefix}_good").alias("good"), F.col(f"{prefix}_unit").alias("unit"), *[v.alias(r) for r, v in scores(prefix).items()])
    judged = materialise(judged, "quality-labelled")
    bins = [F.struct(F.lit(r).alias("rule"), sum((F.col(r) > c).cast("int") for c in grid).alias("bin")) for r, grid in GRID.items()]
    hist = judged.filter(f"{prefix}_design").select("stratum", "good", F.explode(F.array(*bins)).alias("b")).groupBy("stratum", "b.rule", "b.bin", "good").agg(F.count(F.lit(1)).alias("n"))
    proposed = materialise(hist.groupBy("stratum").applyInPandas(lambda pdf: _propose(pdf, alpha), "stratum string, rank int, rule string, cutoff double"), "quality-proposed")

    # the first rule, in the order of the tests, that rejects a good unit of the holdout half
    rows = judged.filter(f"good and not {prefix}_design").join(_by_stratum(proposed, prefix), F.col("stratum") == F.col(f"{prefix}_stratum"))
    first = F.least(*[F.when(F.col(r) > F.col(f"{prefix}_cutoff_{r}"), F.col(f"{prefix}_rank_{r}")).otherwise(len(GRID) + 1) for r in GRID])
    units = rows.groupBy("stratum", "unit").agg(F.min(first).alias("first"))
    tested = units.groupBy(F.col("stratum").alias("_s")).agg(F.count(F.lit(1)).alias("n_good"), F.array(*[F.count_if(F.col("first") <= i) for i in range(1, len(GRID) + 1)]).alias("n_by_rank"))
    tests = proposed.join(tested, F.col("stratum") == F.col("_s"), "left").select("stratum", "rank", "rule", "cutoff", F.coalesce("n_good", F.lit(0)).alias("n_good"), F.coalesce(F.get("n_by_rank", F.col("rank") - 1), F.lit(0)).alias("n_false"))
    level = delta / max(1, proposed.select("stratum").distinct().count())

    def certify(frames):
        for pdf in frames:
            pdf["bound"] = np.array([binomial_upper(int(k), int(n), level) for k, n in zip(pdf["n_false"], pdf["n_good"])], float)
            yield pdf[pdf["bound"] <= alpha]

    # the unions are nested, so their bounds rise with the rank and those below alpha are the first ones
    return materialise(tests.mapInPandas(certify, "stratum string, rank int, rule string, cutoff double, n_good long, n_false long, bound double"), "quality-cutoffs")


def _judged(stats: DataFrame, cutoffs: DataFrame, stratum: str, prefix: str) -> DataFrame:
    """``stats`` with ``prefix``_failed, an array of the rules that reject the row."""
    over = [F.when(F.coalesce(score > F.col(f"{prefix}_cutoff_{r}"), F.lit(False)), F.lit(r)) for r, score in scores(prefix).items()]
    at = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit(""))
    return stats.join(_by_stratum(cutoffs, prefix), at == F.col(f"{prefix}_stratum"), "left").withColumn(f"{prefix}_failed", F.array_compact(F.array(*over)))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, failed_rules."""
    stats = materialise(with_stats(docs, ["doc_id", stratum]), "quality-stats")
    judged = _judged(stats, certified_cutoffs(stats, labels, stratum, alpha, delta), stratum, PREFIX)
    counts = [F.col(f"{PREFIX}_{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = F.col(f"{PREFIX}_failed")
    return judged.select("doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & (F.size(failed) == 0)).alias("kept"), F.concat_ws(",", failed).alias("failed_rules"))


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    prefix = free_name(docs, PREFIX)
    cutoffs = certified_cutoffs(with_stats(docs, ["doc_id", stratum], prefix), labels, stratum, alpha, delta, prefix)
    judged = _judged(with_stats(docs, prefix=prefix), cutoffs, stratum, prefix)
    return judged.filter(~base_failed(prefix) & (F.size(f"{prefix}_failed") == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
