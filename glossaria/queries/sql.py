"""Pieces of DuckDB SQL for the queries' oracles."""

from __future__ import annotations

from glossaria.functions.constants import ABBREVIATIONS, CONTRACTIONS, NAMESPACES, STOPWORDS


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(x: str) -> str:
    for pattern in ("([a-z0-9])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        x = f"regexp_replace({x}, '{pattern}', '\\1 \\2', 'g')"
    return f"list_sort(list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')))"


def token_text(x: str) -> str:
    return f"coalesce(array_to_string({tokens(x)}, ' '), '')"


def bm25_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def humanize(x: str) -> str:
    for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{Nd})", r"(\p{Nd})(\p{L})"):
        x = f"regexp_replace({x}, '{pattern}', '\\1 \\2', 'g')"
    return rf"lower(trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"


def enrich(name: str, path: str, is_array: str, description: str, phrase: str | None = None, hierarchy: bool = True) -> str:
    parents = f"list_slice(string_split({path}, '.'), 1, least(len(string_split({path}, '.')) - 1, 5))"
    shown = f"list_filter({parents}, lambda p: lower(p) NOT IN ({quoted(NAMESPACES)}) AND length(p) > 2)"
    above = f"CASE WHEN contains({path}, '.') THEN nullif(array_to_string(list_transform({shown}, lambda p: {humanize('p')}), ', '), '') END"
    kind = phrase or f"CASE WHEN {is_array} THEN 'array' END"
    lead = above if hierarchy else "NULL"
    return f"trim(regexp_replace(concat_ws(' ', {lead}, nullif({humanize(name)}, ''), {kind}, nullif(trim({description}), '')), '\\s+', ' ', 'g'))"


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


ABBREVIATION_MAP, CONTRACTION_MAP = _map(ABBREVIATIONS), _map(CONTRACTIONS)


def title(x: str) -> str:
    return f"concat(upper({x}[1]), lower({x}[2:]))"


def abbreviation_parts(x: str) -> str:
    cut = f"regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex({cut}, '[_\\-\\s]+'), lambda w: w <> '')"


def expand(x: str) -> str:
    found = f"{ABBREVIATION_MAP}[lower(t)]"
    one = f"CASE WHEN {found} IS NULL THEN t WHEN upper(t) = t AND lower(t) <> t THEN upper({found}) WHEN {title('t')} = t AND regexp_matches(t, '^[A-Z]') THEN {title(found.join(('(', ')')))} ELSE {found} END"
    parts = f"list_transform({abbreviation_parts(x)}, lambda t: {one})"
    camel = f"concat(lower(({parts})[1]), array_to_string(list_transform(list_slice({parts}, 2, 1000), lambda u: {title('u')}), ''))"
    return (
        f"CASE WHEN {x} = '' THEN '' WHEN regexp_matches({x}, '\\s') THEN array_to_string({parts}, ' ') WHEN contains({x}, '_') THEN array_to_string({parts}, '_') "
        f"WHEN contains({x}, '-') THEN array_to_string({parts}, '-') WHEN len({parts}) > 1 THEN {camel} ELSE coalesce(({parts})[1], '') END"
    )


def content_words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^0-9A-Za-z]+'), lambda w: w <> '' AND w NOT IN ({quoted(STOPWORDS)}))"


def aliases(words: str, most: int = 6) -> str:
    """Over a list expression of content words."""
    join = lambda a, s=" ": f"array_to_string({a}, '{s}')"
    contract = lambda otherwise: f"coalesce({CONTRACTION_MAP}[w], {otherwise})"
    each = lambda body, of=words: f"list_transform({of}, lambda w: {body})"
    rest = f"list_slice({words}, 2, 1000)"
    many = f"len({words}) >= 2"
    forms = [
        join(words),
        join(each(contract("w"))),
        join(each("w[1:4]")),
        f"CASE WHEN {many} THEN {join(each('w[1:1]'), '')} END",
        f"CASE WHEN {many} THEN concat_ws(' ', {words}[1], {join(each(contract('w[1:3]'), rest))}) END",
        join(each(contract("w")), ""),
        f"CASE WHEN len({words}) >= 3 THEN {join(rest)} END",
    ]
    kept = f"list_filter([{', '.join(forms)}], lambda a: a IS NOT NULL AND a <> '')"
    return f"list_slice(list_filter({kept}, lambda a, i: list_position({kept}, a) = i), 1, {most})"


def edit_similarity(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


def type_signal(a: str, b: str) -> str:
    both = lambda kinds: f"({a} IN ({quoted(kinds)}) AND {b} IN ({quoted(kinds)}))"
    return (
        f"CASE WHEN {a} = {b} THEN 1.0 WHEN {both(('integer', 'long', 'float', 'double', 'decimal'))} THEN 0.8 WHEN {both(('string', 'uuid', 'json'))} OR {both(('date', 'timestamp'))} THEN 0.9 "
        f"WHEN {a} = 'string' OR {b} = 'string' THEN 0.5 ELSE 0.0 END"
    )


def first_case(tests: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in tests) + f" ELSE {default} END"
