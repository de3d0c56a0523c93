import pytest
from pyspark.sql import functions as F

from zonelex.functions.stemmers import ALGORITHMS, BUILT, stem_with, stemmer
from zonelex.plans.stemming import PAIRS


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_pairs(name):
    words = PAIRS[name].split()
    got = {w: stemmer(name)(w) for w in words[::2]}
    assert got == dict(zip(words[::2], words[1::2]))


def test_registry():
    assert len(ALGORITHMS) == 26 and set(BUILT) <= set(ALGORITHMS)
    assert stemmer("en")("running") == stemmer("english")("running") == "run"
    assert stemmer("de", "iso-8859-1")("häuser".encode("iso-8859-1")) == "haus"
    with pytest.raises(ValueError):
        stemmer("klingon")
    with pytest.raises(NotImplementedError):
        stemmer("tamil")


def test_column(spark):
    df = spark.createDataFrame([("katzen",), (None,)], "t string")
    assert [r[0] for r in df.select(stem_with(F.col("t"), "german")).collect()] == ["katz", None]


def test_every_stemmer_but_porter_has_pairs():
    assert set(PAIRS) == set(BUILT) - {"porter"}


@pytest.mark.parametrize("name", sorted(BUILT))
def test_odd_words(name):
    for word in ("", "a", "é", "ß", "aaaa", "x" * 3_000, "ab1", "-", "ी", "ss", "yy"):
        assert isinstance(stemmer(name)(word), str)
