"""Problem 1: unfilled placeholders, filler, error-page messages and demands for scripts in place of content.

1. Fields are cut into messages: sentences and lines of a body, values of an infobox. Numbers, hexadecimal ids, paths,
   hosts, exceptions and names are masked, which gives a signature. Equal signatures are counted before they are exchanged;
   what names something of its page and begins like no seed is content and goes no further.
2. Message templates are mined with a prefix tree of fixed depth (number of tokens, first three, last token): within a
   leaf, signatures that agree in most places join one template and their differing places become wildcards.
3. Each template is classified once. A short seed list knows how error pages, demands for scripts and filler begin
   (so a sentence *about* an error page is none). Whatever its words, a sentence is residue if its template is closed
   (no name, number or wildcard: nothing of the page it stands on) and it stands in at least ``SPREAD`` contexts:
   content sentences of different pages vary with what the pages are about. A context is the text of a field
   that says something else too, or the page's title, so copies of one article are one context. A template whose places
   are fixed by the tree itself (first three, last) is closed only if no other signature differs there alone.
4. Verdicts are propagated to all messages with the template's signatures.
5. Separately, unresolved slots (``{{{name}}}``, ``%NAME%``, a value that repeats its own key inside a phrase) are
   detected inside ordinary records while the messages are cut.

Cases: null and empty fields have no messages; repeated rows each count; a signature joins the most similar template of
its leaf, of equal ones the first in signature order; very long fields are read whole; an empty table gives no rows; a
missing title column or null title is one title; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from http import HTTPStatus

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_back
from ..session import materialized, table

#: Signatures of one leaf join a template if at least this share of their tokens agree.
SIMILAR = 0.6
#: A message is filler if at least this share of its words is in the filler lexicon.
FILLER_SHARE = 0.6
#: A closed sentence is residue if it stands in at least so many contexts (of 64 classes of their hashes).
SPREAD = 4
#: A body is residue as a whole if at least this share of its tokens is.
WHOLE = 0.7
#: Up to so many signatures with a verdict go to the messages by broadcast; more are joined by an exchange.
BROADCAST_SIGNS = 200_000

# --- slots -------------------------------------------------------------------------------------------------------

_WORD = r"[A-Za-z][\w-]*(?: [\w-]+){0,3}"
_SLOT = re.compile(
    "|".join(
        [
            r"\{\{\{\s*[\w .-]+?\s*\}\}\}",
            r"\{\{ +[\w. ]+? +\}\}",
            r"\$\{[\w.]+\}",
            r"\$\([A-Za-z_]\w*\)",
            r"\$\$[A-Za-z_]\w+\$\$",
            r"(?<![\w%])%[A-Za-z_]\w+%",
            r"##[A-Za-z_]\w+##",
            r"@@[A-Za-z_]\w+@@",
            r"<<\s*[A-Za-z_]\w+\s*>>",
            r"<%=?\s*[\w.]+\s*%>",
            r"(?<![\w\\}_^{$\]])\{(?:\d+|[A-Za-z_][\w]+)\}(?!\})",
            r"(?<!\[)\[(?:insert|enter|add|write|describe|your) [^\[\]\n]+\](?![\](])",
            r"(?<!\[)\[[A-Z][A-Z_]{2,}(?: [A-Z_]{2,})*\](?![\](])",
        ]
    ),
    re.I,
)
_OPENS_SLOT = re.compile(r"[{$%#@<\[]")
_NOTE = re.compile(r"\bX{3,}\b(?:(?!\bXXX)[^\n])*\bX{3,}\b")
_UPPER_SLOT = re.compile(r"(?<!\[)\[[A-Z][A-Z_]{2,}(?: [A-Z_]{2,})*\](?![\](])")
_SOFT_SLOT = re.compile(r"(?<!\[)\[([a-z]+(?:[ _][a-z]+)?)\](?![\](])")
#: editors' remarks in brackets, which are no slots.
_REMARKS = {"sic", "in part", "edit", "note", "citation needed", "emphasis added", "who", "when", "clarification needed", "update", "dubious"}


def _slot(text: str) -> str:
    return " <slot> "


def mark_slots(text: str, put: Callable[[str], str] = _slot) -> str:
    """Replace unresolved slots by ``<slot>`` or what ``put`` makes of them."""
    if "XXX" in text:
        text = _NOTE.sub(lambda m: put(m.group(0)), text)
    if not _OPENS_SLOT.search(text):
        return text

    def replace(m: re.Match) -> str:
        s = m.group(0)
        return s if s[0] == "[" and not s[1:7].lower().startswith(("insert", "enter ", "add ", "write ", "descri", "your ")) and not _UPPER_SLOT.fullmatch(s) else put(s)

    marked = _SLOT.sub(replace, text)
    soft = [m for m in _SOFT_SLOT.finditer(marked) if m.group(1) not in _REMARKS]
    if len(soft) > 1 or soft and marked != text:
        marked = _SOFT_SLOT.sub(lambda m: m.group(0) if m.group(1) in _REMARKS else put(m.group(0)), marked)
    return marked


# --- messages ----------------------------------------------------------------------------------------------------

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?\{([^{}]*)\}")
_EMPHASIS = re.compile(r"'{2,}|\*\*|(?<!\w)__|__(?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_ENTRY = re.compile(r"\n|; |\|")
_ROW = re.compile(r"</(?:tr|td|th|p|li|h\d|div)>|<br ?/?>", re.I)
_CELL = re.compile(r"<th>([^<]*)</th>\s*<td>", re.I)
_HEAD = re.compile(r"([\w ]{1,40}?)\s*[:=]\s*(.*)$", re.S)
_TOKEN = re.compile(r"<slot>|[^\W_]+(?:['’.:/@_-]+[^\W_]+)*|\.\.\.|[^\w\s]", re.U)


def _uncommented(text: str) -> str:
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        out.append(text[at:a])
        at = b + 3
    return " ".join((*out, text[at:]))


def _clean(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", text.replace("<slot>", "\x01")).replace("\x01", "<slot>")
    if "\\" in text:
        text = _COMMAND.sub(r"\1", text)
    return _EMPHASIS.sub("", text) if "''" in text or "**" in text or "__" in text else text


def messages(field: str, text: str) -> list[tuple[str | None, str]]:
    """(key, message) of a field."""
    if "&" in text:
        text = html.unescape(text)
    text = mark_slots(text)
    if "<" in text:
        text = _uncommented(text)
        if field == "infobox":
            text = _CELL.sub(r"\1: ", text)
        text = _ROW.sub("\n", text)
    out: list[tuple[str | None, str]] = []
    if field == "infobox":
        for entry in _ENTRY.split(text):
            entry = _clean(entry).strip(" {}|*'")
            head = _HEAD.match(entry)
            key, value = (head.group(1), head.group(2)) if head and head.group(1).lower() not in ("error", "warning", "fatal error") else (None, entry)
            if value.strip():
                out.append((key, value.strip()))
    else:
        for line in _clean(text).split("\n"):
            out += [(None, x) for x in map(str.strip, _SENTENCE.split(line)) if x]
    return out


#: Words that keep their form when capitalized: those of the status phrases of HTTP.
_STATUS_WORDS = frozenset(w.lower() for s in HTTPStatus if s >= 400 for w in re.findall("[A-Za-z]+", s.phrase)) | {"http", "javascript"}
_HEX = re.compile(r"(?=[a-f]*\d)[0-9a-f]{6,}")
_HOST = re.compile(r"[\w-]+\.(?:example|com|org|net|test)")
_EXCEPTION = re.compile(r"(?:[\w.]+\.)?(?:[A-Z][a-z]+)+(?:Exception|Error)|\w+(?:\.\w+)+(?:Exception|Error)")


class Masks(dict):
    """Memory of what a token becomes where it isn't the first of its message."""

    BOUND = 400_000

    def __missing__(self, token: str) -> str:
        if len(self) > self.BOUND:
            self.clear()
        self[token] = out = self.mask(token)
        return out

    @staticmethod
    def mask(t: str, first: bool = False) -> str:
        low = t.lower()
        if t == "<slot>":
            return t
        if _EXCEPTION.fullmatch(t):
            return "<exception>"
        if low.startswith("http/"):
            return "http"
        if "/" in t:
            return "<path>"
        if _HEX.fullmatch(low):
            return "<hex>"
        if t[0].isdigit():
            return "<num>"
        if _HOST.fullmatch(low):
            return "<host>"
        if not first and t[0].isupper() and t[1:].islower() and low not in _STATUS_WORDS:
            return "<name>"
        return low


class Chunks(dict):
    """Memory of what the tokens of a piece without blanks become; ``first`` if it begins a message."""

    def __init__(self, first: bool = False):
        super().__init__()
        self.first, self.masks = first, Masks()

    def __missing__(self, chunk: str) -> str:
        if len(self) > Masks.BOUND:
            self.clear()
        tokens = _TOKEN.findall(chunk)
        out = [self.masks[t] for t in tokens]
        if self.first and tokens:
            out[0] = Masks.mask(tokens[0], True)
        self[chunk] = masked = " ".join(out)
        return masked


#: Tokens left out where kinds of words are estimated.
_MARKS = frozenset(".,;:!?…()[]{}'\"-–—/|*=<>#&%$")
_CHUNKS, _FIRST = Chunks(), Chunks(True)


def signature(key: str | None, message: str) -> tuple[str, int]:
    """The masked message, whole however long it is, and its number of tokens."""
    chunks = message.split()
    if not chunks:
        return "", 0
    out = list(map(_CHUNKS.__getitem__, chunks))
    out[0] = _FIRST[chunks[0]]
    said = " ".join(filter(None, out))
    masked = said.split(" ")
    n = len(masked)
    if key is not None:
        name = re.sub(r"_?\d+$", "", key.lower()).strip()
        if name and n > 1 and name in message.lower():
            masked = ["<key>" if re.sub(r"_?\d+$", "", t.lower()) == name else m for t, m in zip(_TOKEN.findall(message), masked)]
            return "<value> " + " ".join(masked), n
        return "<value> " + said, n
    if len(set(masked).difference(_MARKS)) <= 0.55 * n or n <= 3:
        low = [t.lower() for t in _TOKEN.findall(message) if t[0].isalnum()]
        kinds = len(set(low))
        if len(low) > 1 and (kinds == 1 or len(low) >= 6 and kinds <= 0.55 * len(low)):
            return "<repeat> " + said, n
    return said, n


_OPEN = re.compile("<(?:name|num|slot|key|path|hex|host|value|repeat)>|^# redirect|^[^\\w<]")
_ENDS = (".", "!", "?", "…")


def _says_nothing_of_the_page(s: str, alone: bool) -> bool:
    """A sentence, or all there is, without a place that depends on the page."""
    return (alone or s.endswith(_ENDS)) and " " in s and not _OPEN.search(s) and sum(w[0].isalpha() for w in s.split(" ")) >= 2


def sign(signature_: str) -> bytes:
    """Sixteen bytes that stand for a signature where messages are exchanged."""
    return xxhash.xxh3_128_digest(signature_)


UNITS = "page_row bigint, field string, sign binary, signature string, n_tokens int, slot boolean, plain boolean, mined boolean, context int"


def cut(pages: DataFrame, whole: bool = False) -> DataFrame:
    """Every message with its signature; ``plain`` if it says nothing of the page; ``mined`` if it may be residue by its
    words or spread; ``context``, one of 64 classes. With ``whole`` only fields that may be residue as a whole are cut: those
    with at least ``WHOLE`` of their tokens in messages with slots or to be mined."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512).to_pydict()
                ids, fields, signs, signatures, sizes, slots, plains, mined, contexts = ([] for _ in range(9))
                known: dict[str, tuple[bytes, bool, bool, bool]] = {}
                for field in ("infobox", "body"):
                    for page, title, text in zip(part["page_row"], part["title"], part[field]):
                        if not text or whole and field == "body" and _surely_content(text):
                            continue
                        said = [signature(k, m) for k, m in messages(field, text)]
                        if not said:
                            continue
                        n, some, lengths = len(said), *zip(*said)
                        for s in some:
                            if s not in known:
                                free = _says_nothing_of_the_page(s, False)
                                known[s] = (sign(s), "<slot>" in s or "<key>" in s, free, _may_be_residue(s, free))
                        short, slot, plain, may = zip(*map(known.__getitem__, some))
                        if n == 1:
                            plain = (_says_nothing_of_the_page(some[0], True),)
                            may = (_may_be_residue(some[0], plain[0]),)
                        if whole and sum(x for x, a, b in zip(lengths, slot, may) if a or b) < WHOLE * sum(lengths):
                            continue
                        ids += [page] * n
                        fields += [field] * n
                        signs += short
                        signatures += some
                        sizes += lengths
                        slots += slot
                        plains += plain
                        mined += may
                        contexts += [xxhash.xxh64_intdigest((title or "") if all(plain) else text) & 63] * n
                types = (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32())
                columns = (ids, fields, signs, signatures, sizes, slots, plains, mined, contexts)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split(" ")[0] for x in UNITS.split(", ")])

    title = F.col("title").cast("string") if "title" in pages.columns else F.lit(None).cast("string").alias("title")
    return pages.select(F.col("page_row").cast("bigint").alias("page_row"), title, "infobox", "body").mapInArrow(rows, UNITS)


# --- templates ---------------------------------------------------------------------------------------------------


class Leaf:
    """The templates of one leaf of the tree. A signature joins the template with which it shares most places, if these
    are at least ``SIMILAR`` of all. Two that share so many share one of the first places that are more than the rest, so
    only templates that agree there, or have a wildcard, are looked at."""

    def __init__(self, size: int):
        self.size = size
        self.least = -(-size * 6 // 10)
        self.places = range(min(3, size), min(size, 3 + size - self.least + 1))
        self.templates: list[list[str]] = []
        self.at: dict[tuple[int, str], list[int]] = defaultdict(list)

    def add(self, tokens: list[str]) -> int:
        best, where = self.least - 1, -1
        if len(self.templates) <= 4 or not self.places:
            few = range(len(self.templates))
        else:
            few = sorted({i for p in self.places for i in self.at.get((p, tokens[p]), ())})
        for i in few:
            same = sum(map(str.__eq__, self.templates[i], tokens))
            if same > best:
                best, where = same, i
        if where < 0:
            where = len(self.templates)
            self.templates.append(tokens)
            for p in self.places:
                self.at[p, tokens[p]].append(where)
        else:
            self.templates[where] = [a if a == b else "<*>" for a, b in zip(self.templates[where], tokens)]
        return where


def _mine(signatures: list[str]) -> list[str]:
    """The template of each signature of one leaf, in order."""
    if len(signatures) == 1:
        return signatures
    tokens = [s.split(" ") for s in signatures]
    leaf = Leaf(len(tokens[0]) if tokens else 0)
    member = [leaf.add(t) for t in tokens]
    return [" ".join(leaf.templates[i]) for i in member]


def _turned(tokens: list[str]) -> list[int]:
    """Hashes of a signature with one place left out, for each place that the tree itself fixes."""
    places = (0, 1, 2, len(tokens) - 1) if len(tokens) > 3 else range(len(tokens))
    return [xxhash.xxh64_intdigest(f"{p} " + " ".join([*tokens[:p], "<*>", *tokens[p + 1 :]])) - (1 << 63) for p in places]


def mine_templates(units: DataFrame, seeds: bool = True) -> DataFrame:
    """(sign, n, template, verdict, turned) of every distinct signature that has a verdict or may get one by its spread
    (``turned`` is not null). Leaves are mined one after the other as they come sorted. Without ``seeds`` only the spread
    of templates decides, which measures how unseen wordings fare."""
    context = F.when(F.col("plain"), F.expr("shiftleft(1L, context)")).otherwise(F.lit(0).cast("bigint"))
    signs = units.where("mined and not slot").groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.bit_or(context).alias("contexts"))
    t = F.split("signature", " ")
    leaf = F.xxhash64(F.size(t), F.array_join(F.slice(t, 1, 3), " "), F.element_at(t, -1))
    spread = F.bit_count("contexts") >= F.lit(SPREAD)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def close(held: list[tuple]) -> None:
            leaves: dict[tuple, list] = defaultdict(list)  # more than one only where hashes of leaves are equal
            if len(held) == 1:
                leaves[()] = held
            else:
                for h in sorted(held):
                    w = h[0].split(" ")
                    leaves[len(w), *w[:3], w[-1]].append(h)
            for leaf in leaves.values():
                kinds: dict[str, str] = {}
                for (s, n, plain, wide), template in zip(leaf, _mine([h[0] for h in leaf])):
                    if template not in kinds:
                        kinds[template] = classify(template) if seeds else ""
                    verdict = kinds[template] or ("filler" if seeds and _filler(s) else None)
                    if verdict or plain:
                        turned = None if verdict else _turned(s.split(" "))
                        repeats = bool(wide and not verdict and "<*>" not in template)
                        out.append((sign(s), n, template if verdict or repeats else None, verdict, turned, repeats))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            out.clear()
            types = (pa.binary(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], ["sign", "n", "template", "verdict", "turned", "spread"])

        here, held = None, []
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                for *h, at in zip(*(part.column(i).to_pylist() for i in range(5))):
                    if at != here and held:
                        close(held)
                        held = []
                    here = at
                    held.append(tuple(h))
                yield flush()
        close(held)
        yield flush()

    ordered = signs.select("signature", "n", (F.col("contexts") != 0).alias("plain"), spread.alias("spread"), leaf.alias("leaf")).repartition("leaf").sortWithinPartitions("leaf")
    return ordered.mapInArrow(mine, "sign binary, n bigint, template string, verdict string, turned array<bigint>, spread boolean")


# --- classification ----------------------------------------------------------------------------------------------

_THING = "(page|site|map|panel|app|section|table|gallery|video|content|box|list|article|text|image|summary)"
_SCRIPTS = "(javascript|java script|scripts?|scripting|cookies)"
_PHRASES = "|".join(sorted((re.sub("-", " - ", s.phrase.lower()).replace("'", " ' ") for s in HTTPStatus if s >= 400), key=len, reverse=True))
#: Seeds: how error pages, demands for scripts and filler begin, over masked and lowered templates.
ERROR = [
    rf"(http )?(error )?(status )?<num>( [-:–])? ({_PHRASES})",
    r"http( status)?( code)? <num>|error :? ?<num>( \.)*$",
    rf"({_PHRASES}|oops|page unavailable|access denied|request blocked|not available|gateway timeout)( \.| !|$| \( <num> \))",
    rf"(oops|whoops|sorry) [,!.] .*\b(page|server|site|link|service|request|{_THING})\b",
    rf"{_THING} (is )?(temporarily )?(unavailable|not (found|available)|failed to load|timed out|introuvable)( \.|$)",
    r"(service|server|connection|request) (unavailable|denied|failed|blocked|refused|timed out|error|is down|temporarily unavailable)",
    r"(something went wrong|an error (has )?occurred)( \.| !| ,|$| (while|when) )",
    r"(unable|failed) to (load|display|connect|open|retrieve|process|fetch|render)\b",
    r"(template|script|lua|database|parse|syntax|fatal) error :",
    r"error : .*(could not|cannot|can not|failed|not found|missing)",
    r"(warning|notice|deprecated) : .*(<path>|stream|undefined|denied|on line)",
    r"traceback \(|at [a-z]+\.[\w.$]+ \(|file \" |\{ \" (status|error|message|code)|<exception>( |$)",
    r"the (requested )?(page|file|address|url|document)( <path>)*( you \w+)? (could not be (located|found)|does not exist|(can not|cannot) be found|was not found)",
    r"it may have been (moved|renamed|deleted)",
    r"you do not have permission",
    r"the ([a-z]+ )?(server|database|host|gateway) did not (answer|respond|accept the connection)",
    r"your request .*(was refused|was blocked|could not be)",
    r"no route matches|our team has been notified|reload (the|this) page|go back \| ",
    r"we are doing some \w+ work|(site )?(under|down for) maintenance",
    r"(please )?try again (in|later|after)|return to the (start|home|main) ?-?page",
    r"(incident|trace|error id|request id|ref|request) (<hex>|<num>)",
    rf"we (could not|can ' t|cannot) (display|load|find) (the|this|that) {_THING}",
    rf"the (remaining|rest of the) {_THING} (failed|could not)",
    r"service momentan|veuillez r.essayer|page (introuvable|non trouvée)|seite nicht gefunden|die angeforderte (adresse|seite)|p[aá]gina no encontrada|vuelva al inicio",
]
SCRIPT = [
    rf"(please )?(enable|activate|turn on|switch on|allow) ({_SCRIPTS}|them to)",
    rf"{_SCRIPTS} (is|are|must be) (disabled|required|blocked|off|switched off|turned off|enabled)",
    r"your browser (does not|doesn ?'? ?t|is out of date|is not supported|has)",
    rf"you (need|have) to (switch on|enable|turn on|activate|allow) .*{_SCRIPTS}",
    rf"this {_THING} (needs|requires|works best with|does not work without|cannot be shown without) .*{_SCRIPTS}|this {_THING} needs scripts",
    r"checking your browser|loading (…|\.\.\.)",
    rf"(to (see|read|view|show) .*|.*\b)(turn on|enable|activate|switch on|allow) {_SCRIPTS} (in your|for this|to)\b",
    rf"without (them|{_SCRIPTS}) the",
    r"(veuillez )?activ\w* (le |la )?javascript|javascript (est|ist) |bitte aktivieren|veuillez activer",
]
FILLER = [
    r"lorem ipsum",
    r"(label|data|sample|dummy) text$",
    r"body copy to follow|click here to edit|replace this (paragraph|text|sentence)|do not publish",
    r"this is (a sample|an example|placeholder|dummy) ",
    r"this (section|page|article|text) is (intentionally|only) (filled|a placeholder)",
    r"(todo|tbd|fixme|tba)\b",
    r"draft <num>( \.)?$|heading <num>$",
    r"xxx .* xxx$",
    r"test test .*test",
    r"(value of|your|enter|insert) .*\bhere$",
    r"\( (enter|insert|add|your) .*here \)|\[ (insert|write|add|enter|describe) ",
    r"(?:(?:add|sample|your|dummy|edit|placeholder|enter|insert) text(?: here)?(?: \.)?(?: |$))+$",
    r"(?:text goes here(?: \.)?(?: |$))+$|(?:xx+(?: \.$| |$))+$|(?:blah(?: \.$| |$))+$|content(?: content)+(?: \.)?$",
]
_ANY = r"(?:<repeat> |<value> )*"
_SEEDS = [(kind, re.compile(_ANY + "(?:" + "|".join(f"(?:{x})" for x in seeds) + ")")) for kind, seeds in (("error", ERROR), ("script", SCRIPT), ("filler", FILLER))]
_NO_VALUE = re.compile(r"<value> (undefined|null|nan|n\.a\.n|#ref !|#n/a|\[ object object \])$")


def classify(template: str) -> str:
    """error, script, filler or '' by the seeds."""
    for kind, seeds in _SEEDS:
        if seeds.match(template):
            return kind
    return "filler" if template.startswith("<repeat> ") or _NO_VALUE.match(template) else ""


#: The words of "lorem ipsum" that are rare in other Latin, of its imitations, and of typing at random.
LEXICON = frozenset(
    (
        "adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt dolor dolore duis eiusmod elit enim "
        "excepteur exercitation fugiat incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi nostrud nulla occaecat officia "
        "pariatur proident reprehenderit sint tempor ullamco velit veniam voluptate "
        "debrit emphalo ere fulgonde irondo mirae nubit onasti passuri quellam salque scalet tormique veluna voritas "
        "asdf bar baz blah foo jkl qux qwe qwerty xx xxx xxxx xxxxx"
    ).split()
)
_PLAIN_WORD = re.compile(r"(?:(?<= )|^)[a-z]{2,}(?= |$)")


def _filler(s: str) -> bool:
    """At least three words, and ``FILLER_SHARE`` of them in the lexicon."""
    if LEXICON.isdisjoint(s.split(" ")):
        return False
    words = _PLAIN_WORD.findall(s)
    return len(words) >= 3 and sum(w in LEXICON for w in words) >= FILLER_SHARE * len(words)


#: The words with which the seeds begin, and those that stand in the only one that doesn't tell its beginning.
_STARTS = frozenset(re.findall(r"\S+", _PHRASES.replace("|", "\n").replace("\\", ""))) | frozenset(
    """http error status <num> oops whoops sorry page access request not gateway site map panel app section table gallery video content box list article text
    image summary service server connection something an unable failed template script lua database parse syntax fatal warning notice deprecated traceback
    at file { <exception> the it you your no our reload go we under down please try return incident trace ref veuillez seite die página pagina vuelva enable
    activate turn switch allow javascript java scripts scripting cookies this checking loading to without bitte lorem label data sample dummy body click replace
    do todo tbd fixme tba draft heading xxx test value enter insert ( [ add edit placeholder blah undefined null nan n.a.n # #n/a #ref""".split()
)
_DEMANDED = frozenset("javascript java script scripts scripting cookies".split())


def _may_be_residue(s: str, plain: bool) -> bool:
    """False for what no seed can match and no spread can make residue, which is not mined."""
    if plain or s.startswith("<repeat>"):
        return True
    tokens = s.split(" ")
    first = tokens[1] if tokens[0] == "<value>" and len(tokens) > 1 else tokens[0]
    return first in _STARTS or first[:5] == "activ" or not first.strip("x") or not _DEMANDED.isdisjoint(tokens) or not LEXICON.isdisjoint(tokens)


_OF_ITS_PAGE = re.compile(r"\d|\s[A-ZÀ-ÖØ-Þ]")
_SIGNS = re.compile(r"[{}$%#@<>\[\]&\\*/_-]")
_LINES = re.compile(r"(?<=[.!?…])\s+|\n+")


def _surely_content(text: str) -> bool:
    """True where over two fifths of the pieces of a body are in sentences that name something of the page, begin like no
    seed and hold no sign of a slot or markup, seen without masking them: such a body is no residue as a whole."""
    content, enough = 0, 0.4 * len(text.split())
    for m in _LINES.split(text):
        if content > enough:
            return True
        pieces = m.split()
        if len(pieces) > 1 and _OF_ITS_PAGE.search(m) and not _SIGNS.search(m):
            words = [p.strip(".,;:!?()\"'") for p in m.lower().split()]
            if words[0].isalpha() and words[0] not in _STARTS and words[0][:5] != "activ" and words[0].strip("x") and _DEMANDED.isdisjoint(words) and LEXICON.isdisjoint(words):
                content += len(pieces)
    return content > enough


def verdicts(units: DataFrame, seeds: bool = True) -> DataFrame:
    """(sign, n, template, verdict) of the signatures that are residue; one classification a template."""
    mined = materialized(mine_templates(units, seeds))
    closed = mined.where("spread").select("sign", "n", "template", F.explode("turned").alias("h"))
    others = mined.where("turned is not null").select(F.explode("turned").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("_alike")).where("_alike > 1")
    varied = closed.join(others, "h").select("sign").distinct()
    spread = closed.select("sign", "n", "template").distinct().join(varied, "sign", "left_anti").withColumn("verdict", F.lit("repeated"))
    return mined.where("verdict is not null").select("sign", "n", "template", "verdict").unionByName(spread)


def judged(pages: DataFrame, seeds: bool = True, whole: bool = False) -> DataFrame:
    """(page_row, field, n_tokens, verdict) of every message; verdict null for content."""
    units = materialized(cut(pages, whole))
    bad = materialized(verdicts(units, seeds).select("sign", "n", "verdict"))
    columns = ["page_row", "field", "n_tokens", "sign", "slot"]
    if bad.count() <= BROADCAST_SIGNS:
        said = units.select(*columns).join(F.broadcast(bad.select("sign", "verdict")), "sign", "left")
    else:
        said = join_back(units.select(*columns), bad, "sign", "n", ["page_row"], outer=True)
    return said.select("page_row", "field", "n_tokens", F.when(F.col("slot"), F.lit("slot")).otherwise(F.col("verdict")).alias("verdict"))


def residue(pages: DataFrame, seeds: bool = True) -> DataFrame:
    """(page_row, field, n_tokens, verdict) of the messages that are residue."""
    return judged(pages, seeds).where("verdict is not null")


def whole_bodies(pages: DataFrame) -> DataFrame:
    """page_row of the rows whose body is residue as a whole."""
    said = judged(pages, whole=True).where("field = 'body'").groupBy("page_row").agg(F.sum("n_tokens").alias("n"), F.sum(F.when(F.col("verdict").isNotNull(), F.col("n_tokens"))).alias("bad"))
    return said.where(F.col("bad") >= F.col("n") * F.lit(WHOLE)).select("page_row")


def found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "wiki_page")).select("page_row", "field").distinct()


def clean_fields(spark: SparkSession, d: str) -> DataFrame:
    """What stays out of the index, by field and kind of residue."""
    return residue(table(spark, d, "wiki_page")).groupBy("field", "verdict").agg(F.count(F.lit(1)).alias("n_messages"), F.countDistinct("page_row").alias("n_rows"))


QUERIES = {"p1_found": found, "p1_residue_kinds": clean_fields}
ORACLE: dict[str, str] = {}
