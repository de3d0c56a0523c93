"""Byte-exact text functions as Column expressions (whole-stage codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

MAX_TOKEN = 25
MIN_TOKEN = 2
MAX_DIGITS = 13

#: Fixed values that must equal the index's own list: 124 English stopwords in their usual order.
STOPWORDS: tuple[str, ...] = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are was
    were be been being have has had having do does did doing would should could ought cannot a an the and but if or because
    as until while of at by for with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how all any both each few more
    most other some such no nor not only own same so than too very""".split()
)


def ascii_lower(c: Column) -> Column:
    """Lower A-Z only; every other character stays (``lower`` would fold non-ASCII letters)."""
    return F.translate(c, UPPER, LOWER)


def is_valid_char(c: Column) -> Column:
    """One character that can stand in a token, before lowering."""
    return c.rlike("^[A-Za-z0-9]$")


def is_digit(c: Column) -> Column:
    return c.rlike("^[0-9]$")


def words(c: Column) -> Column:
    """Maximal runs of ``[a-z0-9]`` of a text that is already lowered."""
    return F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), F.lit(1))


def prefix_at(c: Column, target: str, position: int = 0) -> Column:
    """Does ``c`` hold ``target`` from the 0-based ``position`` on? False where it is too short."""
    return F.coalesce(F.substring(c, position + 1, len(target)) == F.lit(target), F.lit(False))


def any_prefix_at(c: Column, targets: list[str], position: int = 0) -> Column:
    out = F.lit(False)
    for t in targets:
        out = out | prefix_at(c, t, position)
    return out


def is_stopword(tok: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Digits inside a token don't hide a stopword (``t1he`` is one)."""
    if not stopwords:
        return F.lit(False)
    return F.regexp_replace(tok, "[0-9]", "").isin(*stopwords)


def keep_token(tok: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    return (
        F.length(tok).between(MIN_TOKEN, MAX_TOKEN)
        & ~tok.rlike("^[0-9][a-z0-9]*[a-z]")
        & ~tok.rlike("^[0-9]{%d,}$" % (MAX_DIGITS + 1))
        & ~is_stopword(tok, stopwords)
    )
