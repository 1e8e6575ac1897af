"""Column functions over identifiers, names and query texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaria.functions.constants import ABBREVIATIONS, CONTRACTIONS, NAMESPACES, STOPWORDS, TYPE_PHRASES


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _words(text: Column, separators: str) -> Column:
    return F.array_remove(F.split(text, separators), "")


def identifier_tokens(name: Column) -> Column:
    """Sorted distinct lower-case parts, split at case, acronym and digit boundaries."""
    for pattern in ("([a-z0-9])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        name = F.regexp_replace(name, pattern, "$1 $2")
    return F.array_sort(F.array_distinct(_words(F.lower(name), "[^a-z0-9]+")))


def bm25_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order, repeats kept."""
    return _words(F.lower(text), "[^a-z0-9]+")


def humanize(name: Column) -> Column:
    """Words of an identifier in any script, lower-case, separated by blanks."""
    for pattern in (r"(?<=\p{Ll})(?=\p{Lu})", r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", r"(?<=\p{L})(?=\p{Nd})", r"(?<=\p{Nd})(?=\p{L})"):
        name = F.regexp_replace(name, pattern, " ")
    return F.lower(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " ")))


def type_phrase(data_type: Column, is_array: Column, item_type: Column) -> Column:
    """``date field``, ``array of text``."""
    phrases = _map(TYPE_PHRASES)
    of = lambda t: F.coalesce(F.try_element_at(phrases, F.coalesce(t, F.lit("unknown"))), F.lit("data"))
    return F.when(is_array, F.concat(F.lit("array of "), of(item_type))).otherwise(F.concat(of(data_type), F.lit(" field")))


def enrich(name: Column, path: Column, is_array: Column, description: Column, depth: int = 5, phrase: Column | None = None, hierarchy: bool = True) -> Column:
    """Humanized parents joined by ", ", the name, a type phrase or ``array``, and the description."""
    parts = F.split(path, r"\.")
    parents = F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(depth)))
    shown = F.filter(parents, lambda p: ~F.lower(p).isin(*NAMESPACES) & (F.length(p) > 2))
    above = F.when(path.contains("."), F.array_join(F.transform(shown, humanize), ", ")) if hierarchy else F.lit(None).cast("string")
    kind = phrase if phrase is not None else F.when(is_array, F.lit("array"))
    text = F.concat_ws(" ", F.nullif(above, F.lit("")), F.nullif(humanize(name), F.lit("")), kind, F.nullif(F.trim(description), F.lit("")))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def abbreviation_parts(text: Column) -> Column:
    """Parts between underscores, hyphens, white space and case boundaries."""
    return _words(F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "), r"[_\-\s]+")


def _title(word: Column) -> Column:
    return F.initcap(word)


def expand_abbreviations(text: Column, table: Column | None = None) -> Column:
    """``text`` with known parts expanded in their case and put together again as it was."""
    table = _map(ABBREVIATIONS) if table is None else table

    def one(t: Column) -> Column:
        found = F.try_element_at(table, F.lower(t))
        upper = (F.upper(t) == t) & (F.lower(t) != t)
        return F.when(found.isNull(), t).when(upper, F.upper(found)).when((_title(t) == t) & t.rlike("^[A-Z]"), _title(found)).otherwise(found)

    parts = F.transform(abbreviation_parts(text), one)
    camel = F.concat(F.lower(F.get(parts, 0)), F.array_join(F.transform(F.slice(parts, 2, 1000), _title), ""))
    return (
        F.when(text == "", "")
        .when(text.rlike(r"\s"), F.array_join(parts, " "))
        .when(text.contains("_"), F.array_join(parts, "_"))
        .when(text.contains("-"), F.array_join(parts, "-"))
        .when(F.size(parts) > 1, camel)
        .otherwise(F.coalesce(F.get(parts, 0), F.lit("")))
    )


def overlay(base: Column, over: Column) -> Column:
    """Entries of both maps; ``over`` wins."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)


def query_text(name: Column, path: Column, is_array: Column, description: Column, expand: bool = False) -> Column:
    """The text a field is searched by: enriched, expanded level by level, lower-case."""
    text = enrich(name, path, is_array, description)
    if expand:
        text = F.array_join(F.transform(F.split(text, ", "), lambda level: expand_abbreviations(level)), ", ")
    return F.lower(text)


def entity_prefixed(path: Column, entity: Column) -> Column:
    """``path`` below its entity, unless its first of several segments is the entity already."""
    first = F.get(F.split(path, r"\."), 0)
    same = F.array_join(identifier_tokens(first), " ") == F.array_join(identifier_tokens(entity), " ")
    return F.when(path.contains(".") & same, path).otherwise(F.concat_ws(".", F.nullif(entity, F.lit("")), path))


def content_words(name: Column) -> Column:
    return F.filter(_words(F.lower(name), "[^0-9A-Za-z]+"), lambda w: ~w.isin(*STOPWORDS))


def aliases(name: Column, most: int = 6) -> Column:
    """Plausible technical spellings of a business name, most plausible first."""
    words, short = content_words(name), _map(CONTRACTIONS)
    join = lambda a, s=" ": F.array_join(a, s)
    contract = lambda w, otherwise: F.coalesce(F.try_element_at(short, w), otherwise)
    rest = F.slice(words, 2, 1000)
    many = F.size(words) >= 2
    forms = F.array(
        join(words),
        join(F.transform(words, lambda w: contract(w, w))),
        join(F.transform(words, lambda w: F.substring(w, 1, 4))),
        F.when(many, join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")),
        F.when(many, F.concat_ws(" ", F.get(words, 0), join(F.transform(rest, lambda w: contract(w, F.substring(w, 1, 3)))))),
        join(F.transform(words, lambda w: contract(w, w)), ""),
        F.when(F.size(words) >= 3, join(rest)),
    )
    return F.slice(F.array_distinct(F.filter(F.array_compact(forms), lambda a: a != "")), 1, most)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 0 if either is empty."""
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def searchable_text(business: Column, logical: Column, definition: Column, synonyms: Column) -> Column:
    """An entry's text for the indexes; synonyms sorted."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" ", blank(business), blank(F.replace(logical, F.lit("_"), F.lit(" "))), blank(definition), blank(F.array_join(F.array_sort(synonyms), " ")))


def searchable_mode(mode: str, business: Column, logical: Column, definition: Column) -> Column:
    """Parts of ``mode`` (all, business_desc, business) without repeats, case ignored."""
    parts = {"all": [business, F.replace(logical, F.lit("_"), F.lit(" ")), definition], "business_desc": [business, definition], "business": [business]}[mode]
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != ""))
    first = F.filter(kept, lambda p, i: ~F.array_contains(F.transform(F.slice(kept, F.lit(1), i), F.lower), F.lower(p)))
    return F.array_join(first, " ")


def flattened_segments(name: Column) -> Column:
    """Segments of a flattened name: at dots, else at underscores."""
    return F.when(name.contains("."), _words(name, r"\.")).otherwise(_words(name, "_+"))


def path_segments(key: Column) -> Column:
    """Segments of a result key: at dots, else at double underscores, else the whole."""
    return F.when(key == "", F.array().cast("array<string>")).when(key.contains("."), _words(key, r"\.")).when(key.contains("__"), _words(key, "__")).otherwise(F.array(key))


def result_key(flattened: Column, path: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(flattened, F.lit("")), F.nullif(path, F.lit("")), name)


def concept_label(qualifier: Column, leaf: Column, data_type: Column) -> Column:
    """Qualifier, sorted leaf tokens and type: columns of one concept share it."""
    return F.concat_ws("|", F.coalesce(F.lower(qualifier), F.lit("")), F.array_join(identifier_tokens(leaf), " "), data_type)


def header_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def split_values(text: Column, delimiter: str) -> Column:
    return F.filter(F.transform(F.split(text, delimiter), lambda v: F.trim(v)), lambda v: v != "")


def char_pattern(value: Column) -> Column:
    """X, x and 9 for letters and digits, runs as one, 24 characters at most."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Lu}", "X"), r"(?!X)\p{L}", "x"), r"\p{Nd}", "9")
    return F.substring(F.regexp_replace(shape, r"(.)\1+", "$1"), 1, 24)


def normalise_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def name_is_opaque(name: Column) -> Column:
    """At most two tokens, none longer than six."""
    tokens = identifier_tokens(name)
    return (F.size(tokens) <= 2) & (F.coalesce(F.array_max(F.transform(tokens, F.length)), F.lit(0)) <= 6)


def content_hash(text: Column, fold: bool = False) -> Column:
    """SHA-256 of a text, with white space collapsed and case folded if asked."""
    if fold:
        text = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.sha2(text, 256)
