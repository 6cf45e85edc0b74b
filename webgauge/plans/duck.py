"""Expressions of the oracle's SQL dialect, each written out for itself: they share patterns with the library, not code."""

from __future__ import annotations

from ..functions import text, urls


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def part(u: str, k: int) -> str:
    return f"regexp_extract({u}, {q(urls.PATTERN)}, {k})"


def host(u: str) -> str:
    return f"nullif(lower({part(u, 2)}), '')"


def normalize(u: str, add_scheme: bool = False, force_https: bool = False, keep_query: bool = False, keep_slash: bool = False) -> str:
    if add_scheme:
        u = f"(CASE WHEN regexp_matches({u}, {q(urls.HAS_SCHEME)}) THEN {u} WHEN trim({u}) <> '' THEN 'https://' || trim({u}) END)"
    scheme = f"lower({part(u, 1)})"
    port = f"CASE WHEN {scheme} || {part(u, 3)} IN ('http:80', 'https:443') THEN '' ELSE {part(u, 3)} END"
    path = part(u, 4) if keep_slash else f"rtrim({part(u, 4)}, '/')"
    return f"CASE WHEN {scheme} IN ('http', 'https') THEN {q('https') if force_https else scheme} || '://' || lower({part(u, 2)}) || ({port}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END{' || ' + part(u, 5) if keep_query else ''} END"


def resolve(base: str, ref: str) -> str:
    """For references without dot segments."""
    origin = f"lower({part(base, 1)}) || '://' || lower({part(base, 2)}) || {part(base, 3)}"
    folder = f"CASE WHEN regexp_replace({part(base, 4)}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({part(base, 4)}, '[^/]*$', '') END"
    return f"CASE WHEN {part(base, 1)} = '' THEN NULL WHEN regexp_matches({ref}, {q(urls.HAS_SCHEME)}) THEN {ref} WHEN starts_with({ref}, '//') THEN lower({part(base, 1)}) || ':' || {ref} WHEN starts_with({ref}, '/') THEN {origin} || {ref} WHEN starts_with({ref}, '?') THEN {origin} || {part(base, 4)} || {ref} ELSE {origin} || ({folder}) || {ref} END"


def tags(html: str, names: str) -> str:
    return f"regexp_extract_all({html}, {q(rf'(?i)<(?:{names})(?:[\s/][^>]*)?>')})"


def attr(tag: str, name: str) -> str:
    p = q(rf"(?i)[\s\"'/]{name}\s*=\s*[\"']([^\"']*)[\"']")
    return f"CASE WHEN regexp_matches({tag}, {p}) THEN regexp_extract({tag}, {p}, 1) END"


def entities(s: str) -> str:
    for name, value in text.ENTITIES:
        s = f"replace({s}, {q(name)}, {q(value)})"
    return s


def references(s: str) -> str:
    """The same references with or without their semicolon, as HTML reads them in text; a number ends before what is no digit."""
    for name, value in text.ENTITIES:
        if name[1] == "#":
            s = f"regexp_replace({s}, {q(name)}, {q(value)}, 'g')"
            for _ in range(2):  # neighbours share a character
                s = f"regexp_replace({s}, {q(name[:-1] + '([^0-9]|$)')}, {q(value + chr(92) + '1')}, 'g')"
        else:
            s = f"regexp_replace({s}, {q(name + '?')}, {q(value)}, 'g')"
    return s


def fold(s: str) -> str:
    return f"lower(trim(regexp_replace({entities(s)}, {q(text.SPACE)}, ' ', 'g')))"


def issues(facts: str, check: str, rules: dict[str, tuple[str, str] | str], key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, {q(check)} AS \"check\", {q(code)} AS code, {q(c[1] if isinstance(c, tuple) else 'Warning')} AS severity FROM {facts} WHERE {c[0] if isinstance(c, tuple) else c}" for code, c in rules.items())
