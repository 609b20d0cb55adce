"""Bit strings: normalisation to a length, and Hamming distance."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from sliceworks.functions.tokens import strip_blanks


class NormalizedBits(NamedTuple):
    """Three columns: aligned text (null on an issue), padding flag, issue name (null if none)."""

    aligned: Column
    was_padded: Column
    issue: Column


def normalize_bits(
    bits: Column, length: Column, *, align: bool = True, length_name: str = "length"
) -> NormalizedBits:
    """Check a bit string against a length; short ones are zero-padded or are an issue.

    The tests run in a fixed order: missing, empty, bad length, non-binary, too long, too short.
    """

    text = strip_blanks(bits)
    size, expected = F.length(text), length.try_cast("int")
    short_issue = F.lit(None) if align else F.lit(f"bitstring_shorter_than_{length_name}")
    issue = (
        F.when(bits.isNull(), "missing_bitstring")
        .when(text == "", "empty_bitstring")
        .when(expected.isNull() | (expected <= 0), f"invalid_{length_name}")
        .when(~text.rlike(r"\A[01]+\z"), "non_binary_bitstring")
        .when(size > expected, f"bitstring_longer_than_{length_name}")
        .when(size < expected, short_issue)
    )
    usable = issue.isNull()
    # lpad would cut a text that is too long; the issue test has excluded those
    aligned = F.when(usable, F.lpad(text, expected, F.lit("0")))
    return NormalizedBits(aligned, F.coalesce(usable & (size < expected), F.lit(False)), issue)


# Bits that fit a signed long with room for the sign.
WORD = 63


def _word(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("long")


def bit_errors(observed: Column, ideal: Column) -> Column:
    """Hamming distance; null when either text is null or the lengths differ.

    Texts of zeros and ones are compared 63 at a time by machine words, others by character.
    """

    differing = lambda a, b: F.bit_count(_word(a).bitwiseXOR(_word(b)))
    places = F.sequence(F.lit(0), F.ceil(F.length(observed) / WORD).cast("int") - 1)
    piece = lambda text, i: F.substr(text, i * WORD + 1, F.lit(WORD))
    by_words = F.aggregate(
        places, F.lit(0), lambda sum_, i: sum_ + differing(piece(observed, i), piece(ideal, i)))
    pairs = F.zip_with(F.split(observed, ""), F.split(ideal, ""), lambda a, b: a != b)
    by_character = F.size(F.filter(pairs, lambda unequal: unequal))
    binary = r"\A[01]+\z"
    return F.when(observed.isNull() | ideal.isNull() | (F.length(observed) != F.length(ideal)),
                  F.lit(None).cast("int")).when(
        observed.rlike(binary) & ideal.rlike(binary),
        F.when(F.length(observed) <= WORD, differing(observed, ideal)).otherwise(by_words)
    ).otherwise(by_character)
