"""Deterministic assignment and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col


def _hex(key, digits: int) -> Column:
    return F.conv(F.substring(F.sha2(col(key).cast("string"), 256), 1, digits), 16, 10)


def bucket(key, size: int = 10_000) -> Column:
    """The first 8 hex digits of the key's sha256, modulo size."""
    return (_hex(key, 8).cast("long") % size).cast("int")


def unit(key) -> Column:
    """[0, 1) from 13 hex digits."""
    return _hex(key, 13).cast("double") / float(1 << 52)


def closed_unit(key) -> Column:
    """[0, 1] from 8 hex digits, both ends possible."""
    return _hex(key, 8).cast("double") / float(0xFFFFFFFF)


def key_of(*parts) -> Column:
    """Lower-cased, space-collapsed parts joined by a bar; empty or null ones are 'none' (T26, L27)."""
    clean = [F.lower(F.regexp_replace(F.trim(col(p).cast("string")), r"\s+", " ")) for p in parts]
    return F.concat_ws("|", *[F.when(c.isNull() | (c == ""), F.lit("none")).otherwise(c) for c in clean])


def checksum(*columns: str) -> Column:
    """sha256 of the JSON of the columns in order of name: our canonical form."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def deterministic_uuid(key) -> Column:
    """The digits of the key's sha256 in the form of a UUID."""
    h = F.sha2(col(key).cast("string"), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
