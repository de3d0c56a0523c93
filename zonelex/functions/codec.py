"""Codec of frequency strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zone letters in the order in which a frequency string lists them; body comes first, without a letter.
FREQ_ORDER = ("b", "i", "c", "t", "l", "r")


def encode_freq(tf: dict[str, Column]) -> Column:
    """``12i3t1`` from counts by zone letter; zones of 0 or null are left out."""
    parts = []
    for letter in FREQ_ORDER:
        count = tf[letter]
        text = count.cast("string") if letter == "b" else F.concat(F.lit(letter), count.cast("string"))
        parts.append(F.when(count > 0, text).otherwise(F.lit("")))
    return F.concat(*parts)


def decode_freq(freq: Column, letter: str, clamp_title: bool = True) -> Column:
    """Count of one zone; 0 for a null, empty or unreadable string. Title counts are clamped to 1."""
    if letter == "b":
        there, pattern = F.substring(freq, 1, 1).between("0", "9"), r"^(\d+)"
    else:
        there, pattern = F.instr(freq, letter) > 0, letter + r"(\d+)"
    n = F.when(there, F.coalesce(F.regexp_extract(freq, pattern, 1).try_cast("int"), F.lit(0))).otherwise(F.lit(0))
    return F.least(n, F.lit(1)) if letter == "t" and clamp_title else n


def total_freq(freq: Column) -> Column:
    """Uses over all zones, as a BIGINT; the title counts at most once."""
    total = F.lit(0).cast("bigint")
    for letter in FREQ_ORDER:
        total = total + decode_freq(freq, letter).cast("bigint")
    return total
