"""String helpers whose rules differ from the built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, separators: str) -> Column:
    """Pieces between any of the separators; empty pieces don't count."""
    return F.filter(F.split(text, f"[{separators}]"), lambda x: x != "")


def to_first_blank(text: Column) -> Column:
    return F.regexp_extract(text, r"^([^ \t]*)", 1)


def is_numeric(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.lit(False))


def remove_at(text: Column, position: int) -> Column:
    """Without the character at the position (from 0)."""
    return F.concat(F.substring(text, 1, position), F.substr(text, F.lit(position + 2)))


def chomp(text: Column) -> Column:
    """Without one trailing line break."""
    return F.regexp_replace(text, r"\n\z", "")


def last_entries(pairs: Column) -> Column:
    """A map of an array of structs k, v: of a key's repeats the last one counts."""
    keys = F.transform(pairs, lambda p: p["k"])
    # counted from behind, a key's first place is that of its last entry
    last = F.filter(pairs, lambda p, i: F.array_position(F.reverse(keys), p["k"]) == F.size(keys) - i)
    return F.map_from_entries(last)


def info_map(info: Column) -> Column:
    """key=value;flag as a map; a flag has an empty value, of a key's repeats the last one counts."""
    return last_entries(F.transform(tokens(info, ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.instr(x, "=") > 0, F.substr(x, F.instr(x, "=") + 1)).otherwise("").alias("v"))))
