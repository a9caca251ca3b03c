"""Text rules as Column -> Column expressions (JVM only, no Python at run time)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import fixed_values as fv

# every character that counts as white space in Unicode text
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[ \t\n\r\x0b\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def strip_text(c: Column) -> Column:
    """``strip`` for long texts: its look through the whole text is made only where an end has white space."""
    def trim(x: Column) -> Column:
        ends = F.lit(False)
        for c in WS_CHARS:
            ends = ends | F.startswith(x, F.lit(c)) | F.endswith(x, F.lit(c))
        return F.when(ends, strip(x)).otherwise(x)

    return let(c, trim)


def replace_where(c: Column, marks: list[str], pattern: str, by: str) -> Column:
    """``regexp_replace`` on texts that hold one of ``marks``, without which the pattern changes nothing."""
    def change(x: Column) -> Column:
        held = F.contains(x, F.lit(marks[0]))
        for mark in marks[1:]:
            held = held | F.contains(x, F.lit(mark))
        return F.when(held, F.regexp_replace(x, pattern, by)).otherwise(x)

    return let(c, change)


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return strip(F.regexp_replace(c, WS + "+", " "))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def paragraphs(c: Column) -> Column:
    """Non-empty trimmed blocks separated by blank lines."""
    blocks = F.split(text_or_empty(c), r"\n" + WS + r"*\n")
    return F.filter(F.transform(blocks, strip), lambda p: p != "")


def first_positions(keys: Column) -> Column:
    """0-based positions, ascending, of the first occurrence of every distinct key.

    Sorting (key, position) pairs keeps the work at n log n per row and needs no shuffle.
    """
    pairs = F.sort_array(
        F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    )

    def pick(ordered: Column) -> Column:
        firsts = F.filter(
            ordered,
            lambda pair, j: (j == 0) | (F.get(ordered, j - 1)["k"] != pair["k"]),
        )
        return F.sort_array(F.transform(firsts, lambda pair: pair["i"]))

    return let(pairs, pick)


def keep_first(items: Column, key: Callable[[Column], Column]) -> Column:
    """Drop array items whose key was seen earlier in the array."""
    return let(
        items,
        lambda xs: F.transform(
            first_positions(F.transform(xs, key)), lambda p: F.get(xs, p)
        ),
    )


# --- term functions ---------------------------------------------------------

def normalize_terms(c: Column) -> Column:
    """Split camelCase, lowercase, treat ``_ - /`` as spaces, collapse white space."""
    out = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    out = F.regexp_replace(F.lower(out), r"[_\-/]+", " ")
    return collapse_ws(out)


def terms(c: Column) -> Column:
    """Alphanumeric ASCII tokens longer than two characters, in order, repeats kept."""
    found = F.regexp_extract_all(normalize_terms(c), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) > 2)


def keywords(c: Column) -> Column:
    return F.array_distinct(F.filter(terms(c), lambda t: ~t.isin(fv.KEYWORD_STOPWORDS)))


def ngrams(c: Column, n: int) -> Column:
    def build(ts: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(1), F.size(ts) - (n - 1)),
            lambda i: F.array_join(F.slice(ts, i, n), " "),
        )
        return F.when(F.size(ts) < n, F.array().cast("array<string>")).otherwise(
            F.array_distinct(grams)
        )

    return let(terms(c), build)


def overlap(left: Column, right: Column) -> Column:
    """Share of the left terms that occur on the right; 0 for an empty left side."""
    return F.when(F.size(left) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(left)
    )


def near_duplicate_key(c: Column, n: int = 80) -> Column:
    return F.array_join(F.slice(terms(c), 1, n), " ")


def sentences(c: Column) -> Column:
    parts = F.split(collapse_ws(c), r"(?<=[.!?])" + WS + "+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def compact(c: Column, max_chars: int) -> Column:
    def cut(t: Column) -> Column:
        return F.when(F.length(t) <= max_chars, t).otherwise(
            F.concat(rstrip(F.substring(t, 1, max_chars - 3)), F.lit("..."))
        )

    return let(collapse_ws(c), cut)


def content_body(c: Column) -> Column:
    """Drop the context header lines that chunking puts in front of a chunk."""
    def is_header(line: Column) -> Column:
        return strip(line).rlike("^(Page title:|Source URL:|Section:)")

    return strip(F.array_join(F.filter(lines(c), lambda x: ~is_header(x)), "\n"))


def title_ellipsis(c: Column) -> Column:
    def cut(t: Column) -> Column:
        return (
            F.when(t == "", F.lit(fv.DEFAULT_TITLE))
            .when(F.length(t) <= 42, t)
            .otherwise(F.concat(strip(F.substring(t, 1, 39)), F.lit("...")))
        )

    return let(collapse_ws(text_or_empty(c)), cut)


def humanize(c: Column) -> Column:
    """``website_my_site`` -> ``My Site``; only word starts change case."""
    label = F.regexp_replace(text_or_empty(c), "^" + fv.COLLECTION_PREFIX, "")
    label = collapse_ws(F.replace(label, F.lit("_"), F.lit(" ")))
    words = F.split(label, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    titled = F.array_join(
        F.transform(
            words,
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30)),
        ),
        "",
    )
    return F.when(strip(text_or_empty(c)) == "", F.lit(fv.DEFAULT_LABEL)).otherwise(titled)


def sanitize(c: Column, max_chars: int) -> Column:
    out = F.translate(text_or_empty(c), "<>", "  ")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return rstrip(F.substring(collapse_ws(out), 1, max_chars))


def _constraint(c: Column) -> Column:
    bullet = "^" + WS + "*[-*]+" + WS + "*"
    return strip(F.regexp_replace(sanitize(c, fv.MAX_CONSTRAINT_CHARS), bullet, ""))


def merge_constraints(items: Column) -> Column:
    """Sanitize every constraint, drop blanks, keep the first of case-insensitive repeats."""
    cleaned = F.filter(F.transform(items, _constraint), lambda x: x != "")
    return keep_first(cleaned, lambda x: F.lower(collapse_ws(x)))


def normalize_constraints(items: Column) -> Column:
    return merge_constraints(F.slice(items, 1, fv.MAX_CONSTRAINTS))


# --- token estimates ----------------------------------------------------------

def estimate_tokens(c: Column) -> Column:
    """A quarter of the trimmed length, rounded half to even, at least 1; 0 when blank."""
    n = F.length(strip(c))
    rounded = F.bround(n / F.lit(float(fv.CHARS_PER_TOKEN))).cast("int")
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), rounded))


def estimate_tokens_ceil(c: Column) -> Column:
    return F.ceil(F.length(text_or_empty(c)) / F.lit(float(fv.CHARS_PER_TOKEN)))


# --- normalizers ----------------------------------------------------------------

def normalize_line_breaks(c: Column) -> Column:
    out = replace_where(text_or_empty(c), ["\r"], "\r\n?", "\n")
    out = replace_where(out, [" \n", "\t\n"], "[ \t]+\n", "\n")
    return strip_text(replace_where(out, ["\n\n\n"], "\n{3,}", "\n\n"))


def normalize_whitespace(c: Column) -> Column:
    out = replace_where(text_or_empty(c), ["  ", "\t", "\f", "\x0b"], r"[\t\f\x0b][ \t\f\x0b]*| [ \t\f\x0b]+", " ")
    return normalize_line_breaks(replace_where(out, [" \n", "\n "], " *\n *", "\n"))


def strip_boilerplate_lines(c: Column) -> Column:
    pattern = r"(?im)^(?:" + "|".join(fv.BOILERPLATE_LINES) + r")$"
    out = F.regexp_replace(text_or_empty(c), "(?d)" + pattern, "")
    return strip_text(replace_where(out, ["\n\n\n"], "\n{3,}", "\n\n"))


def drop_repeated_lines(c: Column) -> Column:
    """struct(text, removed): keep the first of each line, case-insensitively."""
    stripped = F.transform(lines(text_or_empty(c)), strip)

    def fold(xs: Column) -> Column:
        # a blank line gets a key of its own so that it always survives
        keys = F.transform(
            xs,
            lambda x, i: F.when(x == "", F.concat(F.lit("\n"), i.cast("string"))).otherwise(
                F.lower(x)
            ),
        )
        kept = F.transform(first_positions(keys), lambda p: F.get(xs, p))

        def pack(ys: Column) -> Column:
            joined = replace_where(F.array_join(ys, "\n"), ["\n\n\n"], "\n{3,}", "\n\n")
            return F.struct(
                strip_text(joined).alias("text"), (F.size(xs) - F.size(ys)).alias("removed")
            )

        return let(kept, pack)

    return let(stripped, fold)


def drop_duplicate_paragraphs(c: Column) -> Column:
    """struct(text, removed): keep the first of each paragraph, ignoring case and spacing."""
    def fold(ps: Column) -> Column:
        def pack(kept: Column) -> Column:
            return F.struct(
                strip_text(F.array_join(kept, "\n\n")).alias("text"),
                (F.size(ps) - F.size(kept)).alias("removed"),
            )

        return let(keep_first(ps, lambda p: F.lower(collapse_ws(p))), pack)

    return let(paragraphs(c), fold)


# --- hashes ----------------------------------------------------------------------

def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def fingerprint(c: Column) -> Column:
    """Hash of the lowercase words, blind to case, punctuation and spacing."""
    words = F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}_]+", " ")
    return sha256(F.btrim(words))


def kept_lines(c: Column) -> Column:
    """The non-blank trimmed lines."""
    return F.filter(F.transform(lines(text_or_empty(c)), strip), lambda x: x != "")


def content_hash(c: Column) -> Column:
    """Hash of the non-blank trimmed lines."""
    return lines_hash(kept_lines(c))


def lines_hash(kept: Column) -> Column:
    return sha256(F.array_join(kept, "\n"))


def first_heading(c: Column, max_chars: int = 240) -> Column:
    return first_line(kept_lines(c), max_chars)


def first_line(kept: Column, max_chars: int = 240) -> Column:
    return F.coalesce(F.substring(F.get(kept, F.lit(0)), 1, max_chars), F.lit(""))
