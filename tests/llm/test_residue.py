import random
import time

import pytest

from zonelex.llm import residue as R

SLOTS = ["{{{name}}}", "{{ name }}", "{0}", "{name}", "${NAME}", "$(name)", "$$NAME$$", "%name%", "##NAME##", "@@name@@", "<<name>>", "[insert name]", "[NAME]", "[SUBJECT NAME]"]
NO_SLOTS = [
    "Its motto is {order, work} [sic].", "x_{i}^2", "\\textit{word}", "\\begin{tabular}{ll}", "[1]", "[a link](http://x)", "[[Page]]", "{{small|x}}",
    "$$ x = \\sqrt{m} $$", "100% sure and 5% more", "a < b", "Q&A", "[in part]", "cost $5 and $12",
]


@pytest.mark.parametrize("slot", SLOTS)
def test_slots(slot):
    assert "<slot>" in R.mark_slots(f"He was born in {slot} long ago.")


@pytest.mark.parametrize("text", NO_SLOTS)
def test_no_slots(text):
    assert "<slot>" not in R.mark_slots(text)


ROWS = [
    (1, "name: Polren\nlocation: Ost", "The town lies near the river. It has a bridge."),
    (2, "name: your name here; location: Ost", "404 Not Found\nThe page /a/b could not be located on this server."),
    (3, None, "Please enable JavaScript to run this app."),
    (4, "leader: undefined\narea: NaN", "The library required visitors to enable scripts before they could use it."),
    (5, "", 'The song "Error 404" by the band Ost reached number 7.'),
    (6, "court: court\nmotto: unknown", "The town lies near the river. Something went wrong while loading this section (code ab12cd)."),
    (7, "This panel needs scripts; please allow them to see the summary.", "foo bar baz foo bar baz foo bar"),
    (7, "This panel needs scripts; please allow them to see the summary.", "foo bar baz foo bar baz foo bar"),
    (8, None, None),
    (9, "note: {{small|as listed}}", "It was founded by @@FOUNDER@@ in 1900."),
    (10, "name: x" + "y" * 200_000, "word " * 1 + "The town lies near the river. " * 5000),
    (11, "scale: 7\\times 10^{0}", "Visitors saw a page reading \"not found\", which Oda framed. A placeholder such as {order, work} is replaced."),
]
SCHEMA = "page_row long, infobox string, body string"


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", signature string, n int")


def test_found_fields(spark):
    got = {(r.page_row, r.field) for r in R.residue(pages(spark)).collect()}
    assert got == {(2, "infobox"), (2, "body"), (3, "body"), (4, "infobox"), (6, "body"), (7, "infobox"), (7, "body"), (9, "body")}


def test_whole_bodies(spark):
    assert {r[0] for r in R.whole_bodies(pages(spark)).collect()} == {2, 3, 7, 9}


def test_templates_merge_what_differs():
    signs = ["no route matches <path> alpha .", "no route matches <path> beta .", "other words are in this one"]
    assert R._mine(signs) == ["no route matches <path> <*> .", "no route matches <path> <*> .", "other words are in this one"]


def test_a_leaf_equals_comparing_all_templates():
    def plain(signatures):
        templates, member = [], []
        for s in signatures:
            t = s.split(" ")
            same = [sum(a == b for a, b in zip(x, t)) for x in templates]
            best = max(same, default=0)
            if best >= 0.6 * len(t):
                i = same.index(best)
                templates[i] = [a if a == b else "<*>" for a, b in zip(templates[i], t)]
            else:
                i = len(templates)
                templates.append(t)
            member.append(i)
        return [" ".join(templates[i]) for i in member]

    rng = random.Random(2)
    for n in (1, 3, 5, 8, 12):
        for _ in range(20):
            signs = [" ".join(["a", "b", "c"][:n] + [rng.choice("xyz") + str(rng.randrange(1 + j % 3)) for j in range(n - 3)]) for _ in range(40)]
            assert R._mine(signs) == plain(signs)


def test_a_leaf_of_many_templates_is_mined_fast():
    began = time.perf_counter()
    R._mine([f"no route matches p{i} q{i} r{i} s{i} t{i} u{i} v{i} ." for i in range(20_000)])
    assert time.perf_counter() - began < 5


def test_every_signature_gets_its_template(spark):
    signs = [f"no route matches p{i % 7} q{i} ." for i in range(200)] + ["x", "<value> lorem ipsum"]
    df = spark.createDataFrame([(s, False, False, True, 0) for s in signs for _ in range(1 + len(s) % 3)], "signature string, slot boolean, plain boolean, mined boolean, context int").repartition(5)
    got = {bytes(r.sign): (r.n, r.verdict) for r in R.mine_templates(df).collect()}
    assert got == {R.sign(s): (1 + len(s) % 3, "error" if s.startswith("no") else "filler") for s in signs if s != "x"}


def test_what_is_not_mined_could_not_be_residue(data):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{data}/wiki_page.parquet").to_pydict()
    said = {R.signature(k, m)[0] for f in ("infobox", "body") for x in t[f] if x for k, m in R.messages(f, x)}
    said |= {R.signature(None, m)[0] for m in ("Página no encontrada", "Activez le JavaScript", "xxxx xxxx", "Duis aute irure dolor", "Visitors must enable scripts to", "java.lang.NullPointerException", "503 Service Unavailable")}
    missed = [s for s in said if (R.classify(s) or R._filler(s)) and not R._may_be_residue(s, False)]
    assert missed == [] and sum(R._may_be_residue(s, False) for s in said) < 0.6 * len(said)


CONTENT = [
    "Terror attacks in the city killed nine people.", "Error correction is a technique.", "Forbidden City is a palace complex.", "Not found until 1987, the wreck lies at 90 metres.",
    "Unauthorized copies of the novel circulated.", "Something went wrong during the launch of the rocket.", "This section covers the early Semitic scripts.", "This table lists the scripts of South Asia.",
]
UNSEEN = [
    "Whoops! We can't find what you were after.", "JS appears to be off in your client", "Sorry, our servers are taking a nap.", "HTTP/1.1 503", "La página que busca no existe.",
    "Diese Seite benötigt JavaScript.", "Page under construction.", "Hmm, this link leads nowhere.", "Coming soon.", "Consectetur adipiscing elit, sed do eiusmod.",
]


def wide(rows):
    return [(i, f"Page {i}", None, body) for i, body in enumerate(rows)]


WIDE = "page_row long, title string, infobox string, body string"


def test_content_that_begins_like_a_message(spark):
    assert R.residue(spark.createDataFrame(wide(CONTENT), WIDE)).count() == 0


def test_unseen_wordings_are_found_where_they_repeat(spark):
    town = [f"The town of {w} lies near the river. It has {n} bridges." for n, w in enumerate("Alpha Beta Gamma Delta Epsilon Zeta Eta".split())]
    rows = [f"{t}{' ' if k % 2 else chr(10)}{m}" if k else m for m in UNSEEN for k, t in enumerate(town)]
    got = {r.page_row for r in R.residue(spark.createDataFrame(wide(rows + town), WIDE)).collect()}
    found = [m for i, m in enumerate(UNSEEN) if {i * 7, i * 7 + 1, i * 7 + 2} <= got]
    assert len(found) >= 8 and not [i for i in got if i >= len(rows)]


def test_sentences_that_vary_are_content(spark):
    things = "cell fort lake bat light road throne magnet bridge tower".split()
    rows = []
    for i in range(400):  # one place varies, also where the tree fixes it: the first words and the last
        t = things[i % 10]
        rows.append(f"Nobody knew who had left the {t} behind. A second {t} was added beside the old building. The {t} has to stop and look at it for a while. Many children like the {t}. Own words {i}.")
    copies = ["Nothing varies in this article. Each sentence of it repeats. It was copied."] * 1
    assert R.residue(spark.createDataFrame(wide(rows + copies), WIDE)).count() == 0
    same = [(i, f"Page {i}", None, "Nothing varies here. It tells of Alpha. Each sentence repeats.") for i in range(9)]
    assert R.residue(spark.createDataFrame(same, WIDE)).count() == 0  # copies of one article are one context


def test_more_signatures_than_are_broadcast(spark, monkeypatch):
    rows = wide([f"Error: part {chr(97 + i % 26)}{chr(97 + i // 26)} could not be found. It is a town. It stays." for i in range(300)])
    df = spark.createDataFrame(rows, WIDE)
    expected = sorted(R.residue(df).collect())
    monkeypatch.setattr(R, "BROADCAST_SIGNS", 10)
    assert sorted(R.residue(df).collect()) == expected and len(expected) >= 300


def test_empty_table(spark):
    assert R.residue(spark.createDataFrame([], SCHEMA)).count() == 0


def test_what_stands_late_in_a_long_message_is_found(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))
    rows = [
        (1, None, f"{long} and {{{{{{name}}}}}} lived there."),
        (2, None, f"{long} and @@FOUNDER@@"),
        (3, f"motto: {long} your motto here", None),
        (4, "note: " + "add text here " * 40, None),
        (5, None, f"Error: {long} could not be found."),
        (6, f"motto: {long}", f"{long} and nothing more."),
        (7, "note: " + "blah " * 30_000, None),
    ]
    got = {(r.page_row, r.field) for r in R.residue(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, "body"), (2, "body"), (3, "infobox"), (4, "infobox"), (5, "body"), (7, "infobox")}


def test_filler_is_found_whatever_the_size_of_the_input(spark):
    alone = [(1, None, "Quellam irondo mirae, fulgonde at ere nubit salque voritas emphalo Ost."), (2, None, "Duis aute irure dolor in reprehenderit in voluptate velit.")]
    town = [(10 + i, None, f"The town of {w} lies near the river. It has a bridge.") for i, w in enumerate("alpha beta gamma".split())]
    for rows in (alone, alone + town, (alone + town) * 30):
        assert {r.page_row for r in R.residue(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 2}


def test_editors_notes_inside_a_sentence(spark):
    rows = [(1, None, "It grew for a season XXX write more about Ost XXX and the town lies there."), (2, None, "The XXX Olympiad took place.")]
    assert {r.page_row for r in R.residue(spark.createDataFrame(rows, SCHEMA)).collect()} == {1}
