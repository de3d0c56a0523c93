"""Types and fixed dimensions of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Zone:
    number: int
    name: str
    letter: str
    weight: float


#: The zones of a page in their order, with query letters and ranking weights.
ZONES = (
    Zone(0, "Body", "b", 1.0),
    Zone(1, "Infobox", "i", 2.0),
    Zone(2, "Category", "c", 2.0),
    Zone(3, "Title", "t", 50.0),
    Zone(4, "Links", "l", 1.0),
    Zone(5, "References", "r", 1.0),
)
TITLE = 3
ZONE_OF = {z.letter: z.number for z in ZONES}
#: Fixed value: factor for text behind a zone prefix.
PREFIX_BOOST = 100.0
#: Terms in fewer documents are left out of the merged index.
MIN_DF = 5
#: A split is closed when it has seen so many terms or postings.
SPLIT_TERMS = 10_000
SPLIT_POSTINGS = 1_000_000

PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("revision", T.StructType([T.StructField("text", T.StringType())])),
    ]
)
POSTING = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("zone", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("tf", T.IntegerType())]
)
