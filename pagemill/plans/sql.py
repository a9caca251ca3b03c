"""SQL fragments shared by the twins."""

from __future__ import annotations

from pagemill import fixed_values as fv

WS = r"' \t\n\r\x0b\x0c'"
WSE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items: list[str]) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WSE})"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '[\s\v]+', ' ', 'g')")


def norm_terms(x: str) -> str:
    x = f"regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    x = f"regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return collapse(rf"regexp_replace(lower({x}), '[_\-/]+', ' ', 'g')")


def terms(x: str) -> str:
    return f"list_filter(regexp_extract_all({norm_terms(x)}, '[a-z0-9]+'), lambda t: length(t) > 2)"


def first_wins(xs: str) -> str:
    """Distinct list items in order of first occurrence."""
    return f"list_filter({xs}, lambda v, i: list_position({xs}, v) = i)"


def keywords(x: str) -> str:
    return (
        f"list_distinct(list_filter({terms(x)}, "
        f"lambda t: NOT list_contains({strings(fv.KEYWORD_STOPWORDS)}, t)))"
    )


def fingerprint(x: str) -> str:
    return rf"sha256(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')))"


def tok_estimate(x: str) -> str:
    n = f"length({strip(x)})"
    return f"CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, CAST(round_even({n} / 4.0, 0) AS INT)) END"


def body(x: str) -> str:
    return strip(
        f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches("
        f"{strip('l')}, '^(Page title:|Source URL:|Section:)')), chr(10))"
    )


def compact(x: str, n: int) -> str:
    t = collapse(x)
    return (
        f"CASE WHEN length({t}) <= {n} THEN {t} "
        f"ELSE rtrim(left({t}, {n - 3}), {WSE}) || '...' END"
    )


def sanitize(x: str, n: int) -> str:
    t = f"translate({x}, '<>', '  ')"
    t = rf"regexp_replace({t}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')"
    return f"rtrim(left({collapse(t)}, {n}), {WSE})"


def reads_english(t: str) -> str:
    """Expects a trimmed text column name."""
    letters = rf"length(regexp_replace({t}, '[^\p{{L}}]+', '', 'g'))"
    ascii_letters = f"length(regexp_replace({t}, '[^A-Za-z]+', '', 'g'))"
    words = f"regexp_extract_all(lower({t}), '[a-z]+(?:''[a-z]+)?')"
    hits = f"len(list_filter({words}, lambda w: list_contains({strings(fv.ENGLISH_STOPWORDS)}, w)))"
    foreign = (
        r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{0900}-\x{0D7F}\x{3040}-\x{30FF}"
        r"\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"
    )
    return f"""CASE WHEN {t} = '' THEN false
      WHEN regexp_matches({t}, '{foreign}') THEN false
      WHEN {letters} = 0 THEN false
      WHEN {ascii_letters} / CAST({letters} AS DOUBLE) < 0.85 THEN false
      WHEN len({words}) = 0 THEN false
      WHEN len({words}) < 25 THEN {hits} >= 1
      ELSE {hits} / CAST(len({words}) AS DOUBLE) >= 0.03 OR {hits} >= 3 END"""
