"""Content-policy flags over a prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions.text import WS, let, strip, text_or_empty

_JS_WORD = "[A-Za-z0-9_]"
# only existence matters, so every repeat count is exact: no deep backtracking on long runs
SPAM_PATTERNS = [
    r"([^\n\r\u2028\u2029])\1{6}",
    r"\A[^A-Za-z_]{0,5}\z",
    rf"((?<!{_JS_WORD}){_JS_WORD}+(?!{_JS_WORD}))(?:{WS}+\1){{4}}",
]


def combined_prompt(role: Column, constraints: Column) -> Column:
    return F.lower(F.concat(text_or_empty(role), F.lit(" "), text_or_empty(constraints)))


def _hits(text: Column, phrases: list[str], message: str) -> Column:
    before, after = message.split("%s")
    return F.transform(
        F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p)),
        lambda p: F.concat(F.lit(before), p, F.lit(after)),
    )


def _flag(condition: Column, message: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(condition, F.array(F.lit(message))).otherwise(none)


def basic_violations(text: Column) -> Column:
    return let(
        text,
        lambda t: F.concat(
            _hits(t, fv.BASIC_FORBIDDEN, fv.BASIC_FORBIDDEN_MESSAGE),
            _hits(t, fv.BASIC_RISKY_ROLES, fv.BASIC_RISKY_MESSAGE),
            _flag(F.length(strip(t)) > fv.MAX_PROMPT_CHARS, fv.BASIC_LENGTH_MESSAGE),
        ),
    )


def is_spam(text: Column) -> Column:
    first, *rest = [text.rlike(p) for p in SPAM_PATTERNS]
    for r in rest:
        first = first | r
    return first


def full_violations(text: Column) -> Column:
    """array<struct<category, message>> in reporting order."""
    def tagged(category: str, messages: Column) -> Column:
        return F.transform(
            messages,
            lambda m: F.struct(F.lit(category).alias("category"), m.alias("message")),
        )

    def judge(t: Column) -> Column:
        parts = []
        for category, phrases in fv.POLICY_GROUPS.items():
            message = fv.POLICY_MESSAGES[category]
            if category == "spam":
                found = _flag(is_spam(t), message)
            elif category == "length":
                found = _flag(F.length(strip(t)) > fv.MAX_PROMPT_CHARS, message)
            else:
                found = _hits(t, phrases, message)
            parts.append(tagged(category, found))
        return F.concat(*parts)

    return let(text, judge)
