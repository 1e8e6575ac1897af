"""The four type coercions, protection levels, flags and type compatibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaria.functions.constants import AVRO_TYPES, CATEGORY_MATRIX, DDL_TYPES, DEFAULT_PROTECTION, DEFAULT_TYPE_SCORE, FALSE_WORDS, FROM_STRING, GLOSSARY_TYPES, LEVELS, PROTECTION_WORDS, TRUE_WORDS, TYPE_CATEGORIES, TYPE_MATRIX


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def from_string(name: Column) -> Column:
    """By ordered contained words."""
    low, out = F.lower(F.trim(name)), F.lit("unknown")
    for needed, barred, kind in reversed(FROM_STRING):
        test = F.lit(True)
        for w in needed:
            test = test & low.contains(w)
        for w in barred:
            test = test & ~low.contains(w)
        out = F.when(test, kind).otherwise(out)
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(out)


def coerce_glossary(name: Column) -> Column:
    """By the exact word before a parenthesis."""
    return _lookup(F.trim(F.substring_index(F.lower(F.trim(F.coalesce(name, F.lit("")))), "(", 1)), GLOSSARY_TYPES, "unknown")


def coerce_avro(name: Column) -> Column:
    """By the exact word, else the part before ``(``, ``<`` or ``[``."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.coalesce(F.nullif(_lookup(low, AVRO_TYPES, ""), F.lit("")), _lookup(F.trim(F.regexp_extract(low, r"^([^(<\[]*)", 1)), AVRO_TYPES, "unknown"))


def coerce_ddl(name: Column) -> Column:
    """By ordered prefix patterns."""
    up, out = F.upper(F.trim(F.coalesce(name, F.lit("")))), F.lit("unknown")
    for pattern, kind in reversed(DDL_TYPES):
        out = F.when(up.rlike("^" + pattern), kind).otherwise(out)
    return out


def protection_level(text: Column) -> Column:
    """The level of the first known word or phrase, negations first."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[-_/]+", " "), r"\s+", " ")
    out = F.lit(DEFAULT_PROTECTION)
    for word, level in reversed(PROTECTION_WORDS):
        out = F.when(low.rlike(rf"(?<!\w){word}(?!\w)"), level).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", DEFAULT_PROTECTION).otherwise(out)


def parse_flag(text: Column) -> Column:
    """True, false, or null for anything else."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def type_signal(a: Column, b: Column) -> Column:
    """The entry's type lattice: 1 same, .8 numeric, .9 string-like or temporal, .5 with a string, else 0."""
    both = lambda *kinds: a.isin(*kinds) & b.isin(*kinds)
    return (
        F.when(a == b, 1.0)
        .when(both("integer", "long", "float", "double", "decimal"), 0.8)
        .when(both("string", "uuid", "json") | both("date", "timestamp"), 0.9)
        .when((a == "string") | (b == "string"), 0.5)
        .otherwise(0.0)
    )


def type_compatibility(source: Column, target: Column) -> Column:
    """The directed score of a pair: exact, from the matrix, from the categories, or neutral."""
    pairs = F.create_map(*[F.lit(x) for s, row in TYPE_MATRIX.items() for t, v in row.items() for x in (f"{s}>{t}", v)])
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_CATEGORIES.items() for x in pair])
    cats = F.create_map(*[F.lit(x) for s, row in CATEGORY_MATRIX.items() for t, v in row.items() for x in (f"{s}>{t}", v)])
    key = F.concat_ws(">", source, target)
    category = F.concat_ws(">", F.try_element_at(kinds, source), F.try_element_at(kinds, target))
    return F.when(source == target, 1.0).otherwise(F.coalesce(F.try_element_at(pairs, key), F.try_element_at(cats, category), F.lit(DEFAULT_TYPE_SCORE)))


def compatibility_level(score: Column) -> Column:
    out = F.lit(LEVELS[-1][1])
    for least, name in reversed(LEVELS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out
