"""URL filter by a path-template tree per host.

Path segments are typed (numbers and long hexadecimal names become
wildcards), and equal typed paths of a host are one row with its counts. Level
by level, a child is merged into its node's wildcard where its labelled bad
share isn't significantly different from that of its siblings together; a
child that differs keeps its own branch, however many siblings it has. Levels
go on to the depth of the longest path.
A template's bad share is smoothed towards its host's, the host's towards the
overall one; templates whose smoothed share is high enough are rejected.
Everything is grouped aggregation, so a hot host is aggregated before it is
shuffled; only typed paths, never URLs, meet per host.

Explicit rules come first: of the rules (host, path) whose host is the URL's
or a parent domain and whose path starts the URL's path, the longest decides.

Defined results: a null URL or one without ``://`` has an empty host and path
and is allowed unless its template is rejected; repeated rows are judged
alike; a label for an unknown page_id is ignored; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.llm.storage import materialise

#: Two-sided normal quantile beyond which branches differ.
Z = 2.58
HOST_PRIOR, TEMPLATE_PRIOR = 20.0, 5.0
REJECT_SHARE = 0.6
MIN_LABELLED = 5
#: Rules become one expression; more of them than this are refused.
MAX_RULES = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for where, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(where + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def typed_segments(path: Column) -> Column:
    """The path's segments, typed, as an array."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9]+(?=(\.[A-Za-z]{1,5})?$)", "{n}"), r"^(?=[0-9A-Fa-f-]*[0-9])[0-9A-Fa-f-]{8,}(?=(\.[A-Za-z]{1,5})?$)", "{h}"))


def template_table(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, parts, template, n, labelled, bad, share for every typed path.

    ``pages`` has page_id, host, path; ``labels`` page_id and bad (boolean).
    Levels are built until no path has a further segment.
    """
    typed = pages.select("page_id", "host", typed_segments(F.col("path")).alias("parts"))
    marked = typed.join(labels.select(F.col("page_id").alias("_p"), "bad"), F.col("page_id") == F.col("_p"), "left")
    table = marked.groupBy("host", "parts").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    now = materialise(table.withColumn("template", F.lit("")), "url-templates")
    done, level = None, 0
    while True:
        s = F.get("parts", F.lit(level))
        child = now.groupBy("host", "template", s.alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        parent = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("rows").alias("paths"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        both = child.join(parent.select(F.col("host").alias("_h"), F.col("template").alias("_t"), "children", "paths", "pl", "pb"), (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
        rest_l, rest_b = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
        pooled = (F.col("pb") + 0.5) / (F.col("pl") + 1)
        # with continuity correction: a few labels alone are no difference
        inverse = F.try_divide(F.lit(1), "l") + F.try_divide(F.lit(1), rest_l)
        gap = F.abs(F.try_divide("b", "l") - F.try_divide(rest_b, rest_l)) - 0.5 * inverse
        differs = F.coalesce(gap > Z * F.sqrt(pooled * (1 - pooled) * inverse), F.lit(False))
        merged = F.when(F.col("s").isNull(), F.lit("")).when((F.col("children") > 1) & ~differs, F.lit("/*")).otherwise(F.concat(F.lit("/"), F.col("s")))
        step = both.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("s").alias("_s"), merged.alias("_m"), (F.col("paths") == 1).alias("_alone"))
        joined = now.join(step, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & s.eqNullSafe(F.col("_s")))
        # a path that is alone below its node keeps all its further segments
        tail = F.concat_ws("", F.transform(F.slice("parts", level + 1, F.greatest(F.size("parts") - level, F.lit(0))), lambda x: F.concat(F.lit("/"), x)))
        joined = joined.withColumn("template", F.concat("template", F.when(F.col("_alone"), tail).otherwise(F.col("_m"))))
        # a path that ends here is still a sibling of its node's children, one level on
        table = materialise(joined.withColumn("more", ~F.col("_alone") & (F.size("parts") > level)).drop("_h", "_t", "_s", "_m", "_alone"), "url-templates")
        ended = table.filter("not more").drop("more")
        done = ended if done is None else done.union(ended)
        now = table.filter("more").drop("more")
        if not now.limit(1).count():
            break
        level += 1
    table = done
    overall = table.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 1)).first()[0]
    hosts = table.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    hosts = hosts.select(F.col("host").alias("_h"), ((F.col("hb") + HOST_PRIOR * overall) / (F.col("hl") + HOST_PRIOR)).alias("hp"))
    tpl = table.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb")).join(hosts, F.col("host") == F.col("_h"))
    tpl = tpl.select(F.col("host").alias("_h"), F.col("template").alias("_t"), "tl", ((F.col("tb") + TEMPLATE_PRIOR * F.col("hp")) / (F.col("tl") + TEMPLATE_PRIOR)).alias("share"))
    return table.join(tpl, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).select("host", "parts", "template", "n", "labelled", "bad", F.col("tl").alias("template_labelled"), "share")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, template for each row of ``pages`` (page_id, url)."""
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    table = template_table(base, labels)
    rejected = table.filter((F.col("share") >= REJECT_SHARE) & (F.col("template_labelled") >= MIN_LABELLED))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = base.select("*", rule.alias("rule"), verdict.alias("_verdict"), typed_segments(F.col("path")).alias("parts"))
    rejected = rejected.select(F.col("host").alias("_h"), F.col("parts").alias("_parts"), F.col("template").alias("rejected_template"))
    judged = rows.join(rejected, (F.col("host") == F.col("_h")) & (F.col("parts") == F.col("_parts")), "left")
    by_method = F.when(F.col("rejected_template").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_verdict", by_method).alias("verdict"), "rejected_template")
