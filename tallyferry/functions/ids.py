"""Repeatable identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _hyphenate(hex32: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[hex32.substr(start, length) for start, length in cuts])


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped id hashed from its parts.

    A random uuid() would change whenever a lost task is run again; this one never does.
    """
    return _hyphenate(F.md5(F.concat_ws("\u0001", *[p.cast("string") for p in parts])))


def parse_uuid(col: Column) -> Column:
    """Canonical lower-case UUID text, or null so that the value matches nothing."""
    bare = F.regexp_replace(F.lower(col), r"^urn:uuid:|[{}-]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), _hyphenate(bare))
