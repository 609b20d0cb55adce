"""Token strings: bracket-aware splitting, token normalisation, token counts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BRACKETS = "()[]{}"
# Marks a cut. A private-use character, so that ordinary text cannot contain it.
CUT = "\ue000"
# A token name is lower-case ASCII: a letter, then letters, digits or underscores.
TOKEN_NAME = "[a-z][a-z0-9_]*"
# Unicode white space plus the four separator controls.
BLANK = r"[\s\x1c-\x1f]"


def strip_blanks(text: Column) -> Column:
    """Remove white space of any kind at both ends."""

    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def _segments(text: Column, delimiters: Sequence[str]) -> Column:
    """Pieces between delimiters outside brackets, untrimmed.

    Only a text with an opening bracket pays for the depth count, and that walks over the runs
    between brackets, not over characters.
    """

    ordered = sorted({d for d in delimiters if d}, key=len, reverse=True)
    if not ordered:
        return F.array(text)
    if any(set(d) & set(BRACKETS) for d in ordered):
        raise ValueError("A delimiter must not contain a bracket.")
    singles = "".join(re.escape(d) for d in ordered if len(d) == 1)
    pattern = "|".join([*(re.escape(d) for d in ordered if len(d) > 1),
                        *([f"[{singles}]"] if singles else [])])

    runs = F.regexp_extract_all(text, F.lit(r"(?s)([\(\)\[\]\{\}]|[^\(\)\[\]\{\}]+)"), F.lit(1))
    start = F.struct(
        F.lit(0).alias("round"), F.lit(0).alias("square"), F.lit(0).alias("curly"),
        F.lit("").alias("marked"),
    )

    def step(state: Column, run: Column) -> Column:
        outside = (state["round"] == 0) & (state["square"] == 0) & (state["curly"] == 0)

        def depth(name: str, opener: str, closer: str) -> Column:
            return (
                F.when(run == opener, state[name] + 1)
                .when(run == closer, F.greatest(state[name] - 1, F.lit(0)))
                .otherwise(state[name])
                .alias(name)
            )

        piece = F.when(outside, F.regexp_replace(run, pattern, CUT)).otherwise(run)
        return F.struct(
            depth("round", "(", ")"), depth("square", "[", "]"), depth("curly", "{", "}"),
            F.concat(state["marked"], piece).alias("marked"),
        )

    marked = F.aggregate(runs, start, step, lambda state: state["marked"])
    bracketed = text.rlike(r"[\(\[\{]")
    return F.when(bracketed, F.split(marked, CUT)).otherwise(F.split(text, pattern))


def split_outside_brackets(text: Column, delimiters: Sequence[str]) -> Column:
    """Split at the delimiters (longest first) unless inside ``()``, ``[]`` or ``{}``.

    Stray closers are ordinary text; an unclosed opener keeps the rest in one segment. Segments
    are trimmed, blank ones dropped.
    """

    segments = _segments(text, delimiters)
    if not any(delimiters):
        return segments
    return F.filter(F.transform(segments, strip_blanks), lambda s: s != "")


def _or_else(text: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def _unquoted(token: Column) -> Column:
    return F.regexp_replace(strip_blanks(token), "\\A[\"'`]+|[\"'`]+\\z", "")


def _after_colon(plain: Column) -> Column:
    last = F.regexp_extract(plain, rf"(?sU)([^:]*[^:\s\x1c-\x1f][^:]*)(?::{BLANK}*)*\z", 1)
    return F.when(plain.contains(":"), _or_else(strip_blanks(last), plain)).otherwise(plain)


def _first_name(part: Column) -> Column:
    # cutting the part at a blank or bracket and stripping closers, as a reader would, cannot
    # change which name comes first in it
    return F.regexp_extract(part, TOKEN_NAME, 0)


def normalize_tokens(tokens: Column) -> Column:
    """Names of lower-case tokens: the first identifier in each, or in its last ``:`` part.

    A token without any identifier stays as it is, but trimmed and unquoted. The first array pass
    settles nearly all tokens with one pattern, which takes the whole text where there is no
    identifier; the second spends more on the few others.
    """

    name_or_all = rf"{TOKEN_NAME}|\A[^a-z]*\z"
    first = F.transform(tokens, lambda t: F.when(t.contains(":"), t).otherwise(
        F.regexp_extract(t, name_or_all, 0)))

    def rest(t: Column) -> Column:
        # a one-element array carries the colon part to the last step, so that it is computed once
        parts = F.transform(F.array(t), lambda x: _after_colon(_unquoted(x)))
        named = F.transform(parts, lambda p: _or_else(_first_name(p), p))
        is_name = (t >= "a") & (t < "{") & ~t.contains(":")
        return F.when(is_name, t).when(t.contains(":"), F.get(named, F.lit(0))).otherwise(
            _unquoted(t))

    return F.transform(first, rest)


def raw_tokens(text: Column, delimiters: Sequence[str]) -> Column:
    """Lower-case pieces between the delimiters, as they are; null for null."""

    if all(d.lower() == d.upper() for d in delimiters):
        segments = _segments(F.lower(text), delimiters)  # the delimiters have no case
    else:
        segments = F.transform(_segments(text, delimiters), F.lower)
    return F.filter(segments, lambda s: s != "")


def parse_tokens(text: Column, delimiters: Sequence[str]) -> Column:
    """Array of normalised tokens; empty for null or blank text."""

    tokens = normalize_tokens(raw_tokens(text, delimiters))
    kept = F.filter(tokens, lambda t: t != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def plain_token(name: str) -> str:
    """The normal form of a token given as a Python literal, as :func:`normalize_tokens` has it."""

    plain = name.strip().lower().strip("\"'`")
    filled = [part.strip() for part in plain.split(":") if part.strip()]
    last = filled[-1] if ":" in plain and filled else plain
    found = re.search(TOKEN_NAME, last)
    return found.group() if found else last


def count_token(tokens: Column, name: str) -> Column:
    """How often one token occurs."""

    wanted = plain_token(name)
    return F.size(F.filter(tokens, lambda t: t == wanted))


def count_distinct_tokens(tokens: Column) -> Column:
    """How many different tokens occur."""

    return F.size(F.array_distinct(tokens))


def share_in_set(tokens: Column, names: Sequence[str]) -> Column:
    """Share of tokens that belong to a set; 0 without tokens."""

    wanted = sorted({plain_token(n) for n in names})
    hits = F.size(F.filter(tokens, lambda t: t.isin(*wanted)))
    return F.when(F.size(tokens) > 0, hits / F.size(tokens)).otherwise(F.lit(0.0))
