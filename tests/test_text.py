import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonelex.functions import codec
from zonelex.functions.porter import stem
from zonelex.functions.text import STOPWORDS, any_prefix_at, ascii_lower, is_digit, is_valid_char, keep_token, prefix_at, words
from zonelex.operators.zones import Kept, infobox_failures, split_zones, tokens

STEMS = """caresses caress ponies poni cats cat feed feed agreed agre plastered plaster bled bled sing sing sized size hopping hop
falling fall filing file happy happi sky sky say sai relational relat rational ration adoption adopt cease ceas roll roll us u one on
name name city citi cities citi category categori infobox infobox eferences efer ferences ferenc xternal xternal ternal ternal links link
running run""".split()


@pytest.mark.parametrize("word, expected", list(zip(STEMS[::2], STEMS[1::2])))
def test_porter(word, expected):
    assert stem(word) == expected


@given(st.text("abcdefghijklmnopqrstuvwxyz", max_size=12))
def test_porter_never_grows_much_and_stays_lower(word):
    s = stem(word)
    assert len(s) <= len(word) + 1 and s == s.lower()


TEXT = "the 3d t1he 12ab 2020 12345678901234 1234567890123 Café x running b2b isn't"


def test_tokens_of_index_and_query_side(spark):
    lowered = spark.createDataFrame([(TEXT,)], "t string").select(ascii_lower(F.col("t"))).first()[0]
    assert tokens(lowered, Kept(frozenset(STOPWORDS))) == ["2020", "1234567890123", "caf", "run", "b2b", "isn"]
    assert tokens(lowered, Kept(frozenset()))[:3] == ["the", "t1he", "2020"]


def test_lowering_is_ascii_only(spark):
    assert spark.createDataFrame([("ÀBKK",)], "t string").select(ascii_lower(F.col("t"))).first()[0] == "ÀbKk"


def test_column_filter_equals_python_filter(spark):
    df = spark.createDataFrame([(TEXT.lower(),)], "t string").select(F.explode(words(F.col("t"))).alias("tok"))
    kept = [r[0] for r in df.where(keep_token(F.col("tok"))).collect()]
    assert kept == ["2020", "1234567890123", "caf", "running", "b2b", "isn"]


def test_prefix_predicates(spark):
    r = spark.createDataFrame([("abc",), (None,)], "t string")
    got = [tuple(x) for x in r.select(prefix_at(F.col("t"), "bc", 1), prefix_at(F.col("t"), "cd", 2), any_prefix_at(F.col("t"), ["x", "ab"]), is_valid_char(F.lit("é")), is_digit(F.lit("7"))).collect()]
    assert got == [(True, False, True, False, True), (False, False, False, False, True)]


@pytest.mark.parametrize(
    "text, expected",
    [
        (
            "{{infobox city |name={{lang|x}} }}intro text == references == ref one == external links == link one [[category:cities]] tail",
            [(1, "infobox city |name={{lang|x}} }}"), (5, "eferences == ref one "), (4, "xternal links == link one "), (2, "category:cities]]"), (0, "intro text  tail")],
        ),
        ("foo[[category:x]]bar", [(2, "category:x]]"), (0, "foobar")]),
        ("{{infobox {{a}} b", [(1, "infobox {{a}} b")]),
        ("{{ infobox x}}", [(1, " infobox x}}")]),
        ("=== references === z", [(5, "eferences === z"), (0, "=")]),
        ("[[category:open", [(2, "category:open")]),
        ("", []),
    ],
)
def test_zones(text, expected):
    assert split_zones(text)[0] == expected


def test_zones_without_marker():
    assert split_zones("a == references == b", skip_marker=True)[0] == [(5, "b"), (0, "a ")]


@given(st.lists(st.sampled_from(["{{infobox ", "{{", "}}", "[[category:", "]]", "== references ==", "==external links==", "x ", "é"]), max_size=12))
def test_zones_lose_no_token_of_the_body_and_never_fail(parts):
    found, _ = split_zones("".join(parts))
    assert all(0 <= z <= 5 for z, _ in found)


def test_open_infobox_is_logged(spark):
    p = spark.createDataFrame([(0, "A", "{{Infobox {{a}} b"), (1, "B", "{{Infobox a}} b"), (2, "C", None)], "doc_id long, title string, text string")
    assert [tuple(r) for r in infobox_failures(p).collect()] == [(0, "a")]


@given(st.lists(st.integers(0, 99), min_size=6, max_size=6))
def test_freq_round_trip_in_plain_python(tf):
    # the format itself: body first without a letter, zones of 0 left out
    import re

    s = "".join(("" if z == "b" else z) + str(n) for z, n in zip(codec.FREQ_ORDER, tf) if n)
    back = [int(m.group(1)) if (m := re.search(("^" if z == "b" else z) + r"(\d+)", s)) else 0 for z in codec.FREQ_ORDER]
    assert back == tf


def test_freq_codec(spark):
    df = spark.createDataFrame([("12i3t1",), ("c2r5",), ("t7",), ("i3",), ("",), (None,)], "f string")
    got = [tuple(r) for r in df.select(*[codec.decode_freq(F.col("f"), z) for z in codec.FREQ_ORDER]).collect()]
    assert got == [(12, 3, 0, 1, 0, 0), (0, 0, 2, 0, 0, 5), (0, 0, 0, 1, 0, 0), (0, 3, 0, 0, 0, 0), (0,) * 6, (0,) * 6]
    back = df.select(codec.encode_freq({z: codec.decode_freq(F.col("f"), z, clamp_title=False) for z in codec.FREQ_ORDER})).collect()
    assert [r[0] for r in back] == ["12i3t1", "c2r5", "t7", "i3", "", ""]


def test_gaps(spark):
    from zonelex.operators.gaps import gap_decode, gap_encode

    rows = [("a", 4), ("a", 9), ("a", 10), ("b", 0), ("b", 3)] + [("hot", i * 3 + 1) for i in range(500)]
    g = gap_encode(spark.createDataFrame([(t, d, "x") for t, d in rows], "term string, doc_id long, gap_note string"))
    got = sorted((r.term, r.doc_id, r.gap) for r in g.collect())
    assert got[:5] == [("a", 4, 4), ("a", 9, 5), ("a", 10, 1), ("b", 0, 0), ("b", 3, 3)]
    assert {x for t, _, x in got[6:]} == {3} and got[5][2] == 1  # across partition borders too
    back = gap_decode(g.withColumnRenamed("doc_id", "place"), "place")
    assert sorted((r.term, r.doc_id) for r in back.collect()) == sorted(rows)
