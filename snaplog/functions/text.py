"""Column functions for command text and for showing keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inline_arguments(line: Column) -> Column:
    """The arguments of a command line: split at blanks, runs of blanks count once, no quoting; a line's end is no part of it."""
    bare = F.regexp_replace(line, r"\r?\n?$", "")
    return F.filter(F.split(bare, " "), lambda x: x != "")


def command_name(arguments: Column) -> Column:
    """The upper-cased first argument; null for an empty command."""
    return F.upper(F.get(arguments, F.lit(0)))


def padded_key(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def entry_bytes(key: Column, value: Column) -> Column:
    """Bytes of key and value together; a tombstone has those of its key."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))
