"""Sequence text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def letters(text: Column) -> Column:
    """Upper-case ASCII letters of a text, everything else removed."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]+", ""))


def words(text: Column, min_len: int = 1) -> Column:
    """Letter runs of the whole text as upper-case sequences."""
    parts = F.split(F.regexp_replace(text, "[^A-Za-z]+", " "), " ")
    return F.transform(F.filter(parts, lambda w: F.length(w) >= min_len), F.upper)


def equate_residues(seq: Column, coarse: bool = True) -> Column:
    """I -> L, and with a coarse tolerance K -> Q except on the last position."""
    plain = F.translate(seq, "I", "L")
    if not coarse:
        return plain
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    return F.concat(F.translate(body, "K", "Q"), F.right(plain, F.lit(1)))


def hash_hex(*parts: Column) -> Column:
    """A seedable hash that every engine computes alike: hex digits of md5."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
