"""Snowball stemmers by name or language code, and their column form.

The engine indexes with ``porter``. The others follow the published rules of their languages; words are expected in lower
case and composed (NFC) form. An unknown name raises ``ValueError``; a listed algorithm that isn't built
yet raises ``NotImplementedError``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import STEP_2 as PORTER_2
from .porter import _finder, stem as porter
from .stemmers_more import arabic, finnish, hindi, hungarian, indonesian, irish, lithuanian, nepali, romanian

#: The algorithms with their language codes.
ALGORITHMS = {
    "arabic": ("ar", "ara"), "basque": ("eu", "eus", "baq"), "catalan": ("ca", "cat"), "danish": ("da", "dan"), "dutch": ("nl", "dut", "nld"),
    "english": ("en", "eng"), "finnish": ("fi", "fin"), "french": ("fr", "fre", "fra"), "german": ("de", "ger", "deu"), "greek": ("el", "gre", "ell"),
    "hindi": ("hi", "hin"), "hungarian": ("hu", "hun"), "indonesian": ("id", "ind"), "irish": ("ga", "gle"), "italian": ("it", "ita"), "lithuanian": ("lt", "lit"),
    "nepali": ("ne", "nep"), "norwegian": ("no", "nor"), "porter": (), "portuguese": ("pt", "por"), "romanian": ("ro", "rum", "ron"), "russian": ("ru", "rus"),
    "spanish": ("es", "esl", "spa"), "swedish": ("sv", "swe"), "tamil": ("ta", "tam"), "turkish": ("tr", "tur"),
}


def _regions(word: str, vowels: str, at_least: int = 0) -> tuple[int, int]:
    """Starts of R1 and R2: behind the first non-vowel that follows a vowel, and the same again."""
    step = re.compile(f"[^{vowels}]*[{vowels}]+[^{vowels}]")
    m = step.match(word)
    r1 = m.end() if m else len(word)
    m = step.match(word, r1) if m else None
    r2 = m.end() if m else len(word)
    return max(r1, min(at_least, len(word))), r2


# --- English ---------------------------------------------------------------------------------------------------------

_EN_V = "aeiouy"
#: Words with stems of their own, and words left alone.
_EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Fixed values of the published rules.
_EN_2 = {k: v for k, v in PORTER_2.items() if k not in ("abli", "eli")} | {"abli": "able", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_4 = tuple("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
_en_2, _en_3, _en_4 = _finder(_EN_2), _finder(_EN_3), _finder(_EN_4)
_EN_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def english(word: str) -> str:
    if word in _EN_SPECIAL:
        return _EN_SPECIAL[word]
    if len(word) < 3:
        return word
    w = word.lstrip("'") if word[0] == "'" else word
    w = re.sub(r"([aeiouy])y", r"\1Y", "Y" + w[1:] if w[:1] == "y" else w)
    r1, r2 = _regions(w, _EN_V)
    for start in ("gener", "commun", "arsen"):
        if w.startswith(start):
            r1 = len(start)
            m = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]").match(w, r1)
            r2 = m.end() if m else len(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _EN_KEPT:
        return w
    if w.endswith(("eed", "eedly")):
        n = 3 if w.endswith("eed") else 5
        if len(w) - n >= r1:
            w = w[:-n] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if re.search("[aeiouy]", w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                        w = w[:-1]
                    elif r1 >= len(w) and _EN_SHORT.search(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_V:
        w = w[:-1] + "i"
    s = _en_2(w)
    if s and len(w) - len(s) >= r1:
        before = w[-len(s) - 1 : -len(s)]
        if s == "ogi":
            w = w[:-1] if before == "l" else w
        elif s == "li":
            w = w[:-2] if before in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(s)] + _EN_2[s]
    s = _en_3(w)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - 5 >= r2):
        w = w[: -len(s)] + _EN_3[s]
    s = _en_4(w)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not _EN_SHORT.search(w[:-1])) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# --- the Scandinavian languages --------------------------------------------------------------------------------------


def _ending(word: str, suffixes: tuple[str, ...], region: int) -> str:
    """The longest suffix of the word that lies in the region."""
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= region), key=len, default="")


#: Fixed values of the published rules.
_SV_1 = tuple("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s".split())


def swedish(word: str) -> str:
    r1, _ = _regions(word, "aeiouyäåö", 3)
    w, s = word, _ending(word, _SV_1, r1)
    if s and (s != "s" or w[-2:-1] in tuple("bcdfghjklmnoprtvy")):
        w = w[: -len(s)]
    if _ending(w, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        w = w[:-1]
    s = _ending(w, ("lig", "ig", "els", "löst", "fullt"), r1)
    return w[:-1] if s in ("löst", "fullt") else w[: len(w) - len(s)]


#: Fixed values of the published rules.
_NO_1 = tuple("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert".split())
_NO_3 = tuple("leg eleg ig eig lig elig els lov elov slov hetslov".split())


def norwegian(word: str) -> str:
    v = "aeiouyæåø"
    r1, _ = _regions(word, v, 3)
    w, s = word, _ending(word, _NO_1, r1)
    if s in ("erte", "ert"):
        w = w[: -len(s)] + "er"
    elif s == "s":
        before = w[-2:-1]
        if before in tuple("bcdfghjlmnoprtvyz") or before == "k" and w[-3:-2] not in tuple(v):
            w = w[:-1]
    elif s:
        w = w[: -len(s)]
    if _ending(w, ("dt", "vt"), r1):
        w = w[:-1]
    return w[: len(w) - len(_ending(w, _NO_3, r1))]


#: Fixed values of the published rules.
_DA_1 = tuple("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s".split())


def danish(word: str) -> str:
    r1, _ = _regions(word, "aeiouyæåø", 3)
    w, s = word, _ending(word, _DA_1, r1)
    if s and (s != "s" or w[-2:-1] in tuple("abcdfghjklmnoprtvyzå")):
        w = w[: -len(s)]

    def shorter(x: str) -> str:
        return x[:-1] if _ending(x, ("gd", "dt", "gt", "kt"), r1) else x

    w = shorter(w)
    if w.endswith("igst"):
        w = w[:-2]
    s = _ending(w, ("ig", "lig", "elig", "els", "løst"), r1)
    if s == "løst":
        w = w[:-1]
    elif s:
        w = shorter(w[: -len(s)])
    if len(w) > r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouyæåø":
        w = w[:-1]
    return w


# --- German ----------------------------------------------------------------------------------------------------------


def german(word: str) -> str:
    v = "aeiouyäöü"
    w = re.sub(f"(?<=[{v}])([uy])(?=[{v}])", lambda m: m.group(1).upper(), word.replace("ß", "ss"))
    r1, r2 = _regions(w, v)
    r1 = max(r1, min(3, len(w)))
    s = max((x for x in ("em", "ern", "er", "e", "en", "es", "s") if w.endswith(x)), key=len, default="")
    if s and len(w) - len(s) >= r1 and (s != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = max((x for x in ("en", "er", "est", "st") if w.endswith(x)), key=len, default="")
    if s and len(w) - len(s) >= r1 and (s != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = max((x for x in ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit") if w.endswith(x)), key=len, default="")
    if s and len(w) - len(s) >= r2 and not (s in ("ig", "ik", "isch") and w[: -len(s)].endswith("e")):
        w = w[: -len(s)]
        if s in ("end", "ung"):
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif s in ("lich", "heit"):
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        elif s == "keit":
            for x in ("lich", "ig"):
                if w.endswith(x) and len(w) - len(x) >= r2:
                    w = w[: -len(x)]
                    break
    return w.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


# --- Russian ---------------------------------------------------------------------------------------------------------

#: Fixed values of the published rules.
_RU_GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
_RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
_RU_VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    v = "аеиоуыэюя"
    m = re.search(f"[{v}]", w)
    if not m:
        return w
    rv = m.end()
    _, r2 = _regions(w, v)

    def cut(x: str, after_a: list[str], free: list[str]) -> str | None:
        """Without the longest listed ending in RV; endings of the first list only behind а or я."""
        found = sorted({s for s in [*after_a, *free] if x.endswith(s) and len(x) - len(s) >= rv}, key=len, reverse=True)
        for s in found[:1]:
            rest = x[: -len(s)]
            if s in free or len(rest) > rv and rest[-1] in "ая":
                return rest
            shorter = [f for f in found[1:] if f in free]
            return x[: -len(shorter[0])] if shorter else None
        return None

    done = cut(w, *_RU_GERUND)
    if done is None:
        w = cut(w, [], ["ся", "сь"]) or w
        adjective = cut(w, [], _RU_ADJECTIVE)
        if adjective is not None:
            done = cut(adjective, *_RU_PARTICIPLE) or adjective
        else:
            done = cut(w, *_RU_VERB)
            if done is None:
                done = cut(w, [], _RU_NOUN)
    w = done if done is not None else w
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    for s in ("ость", "ост"):
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    for s in ("ейше", "ейш"):
        if w.endswith(s) and len(w) - len(s) >= rv:
            w = w[: -len(s)]
            break
    if w.endswith("нн"):
        w = w[:-1]
    elif w.endswith("ь"):
        w = w[:-1]
    return w


# --- the Romance languages -------------------------------------------------------------------------------------------


def _rv(word: str, vowels: str) -> int:
    """Start of RV: by the first two letters, behind the next vowel, the next consonant, or the third letter."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        after = [i for i in range(2, len(word)) if word[i] in vowels]
    elif word[0] in vowels:
        after = [i for i in range(2, len(word)) if word[i] not in vowels]
    else:
        return 3
    return after[0] + 1 if after else len(word)


def _longest(word: str, suffixes, region: int = 0) -> str:
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= region), key=len, default="")


class _Word:
    """A word with its regions, from whose end suffixes are taken."""

    def __init__(self, text: str, vowels: str):
        self.text, self.rv = text, _rv(text, vowels)
        self.r1, self.r2 = _regions(text, vowels)

    def drop(self, suffixes, region: int) -> str:
        """Drop the longest of the suffixes that the word has, if it lies in the region."""
        s = _longest(self.text, suffixes)
        if s and len(self.text) - len(s) >= region:
            self.text = self.text[: -len(s)]
            return s
        return ""


#: Fixed values by language: suffix, region, replacement, and suffixes then dropped in R2 where they come before it.
_Standard = list[tuple[str, str, str, tuple[tuple[str, ...], ...]]]


def _standard(w: _Word, rules: _Standard) -> bool:
    """The rule with the longest suffix of the word, if its region allows."""
    best = max(((s, r) for r in rules for s in r[0].split() if w.text.endswith(s)), key=lambda x: len(x[0]), default=None)
    if best is None:
        return False
    suffix, (_, region, replacement, before) = best
    if len(w.text) - len(suffix) < getattr(w, region):
        return False
    w.text = w.text[: -len(suffix)] + replacement
    for group in before:
        if not w.drop(group, w.r2):
            break
        if group and group[0] != "iv":  # only -iv may be followed by another
            break
    return True


_ES_V = "aeiouáéíóúü"
#: Fixed values of the published rules.
_ES_PRONOUN = "me se sela selo selas selos la le lo las les los nos".split()
_ES_STANDARD: _Standard = [
    ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", "r2", "", ()),
    ("adora ador ación adoras adores aciones ante antes ancia ancias", "r2", "", (("ic",),)),
    ("logía logías", "r2", "log", ()), ("ución uciones", "r2", "u", ()), ("encia encias", "r2", "ente", ()),
    ("amente", "r1", "", (("iv", "os", "ic", "ad"), ("at",))), ("mente", "r2", "", (("ante", "able", "ible"),)),
    ("idad idades", "r2", "", (("abil", "ic", "iv"),)), ("iva ivo ivas ivos", "r2", "", (("at",),)),
]
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_VERB = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán
irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió
ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos
iésemos ásemos""".split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    w = _Word(word, _ES_V)
    s = _longest(w.text, _ES_PRONOUN, w.rv)
    if s:
        rest = w.text[: -len(s)]
        e = _longest(rest, ("iéndo", "ándo", "ár", "ér", "ír", "iendo", "ando", "ar", "er", "ir", "yendo"), w.rv)
        if e and (e != "yendo" or rest.endswith("uyendo")):
            w.text = rest[: -len(e)] + e.translate(_ACUTE)
    if not _es_standard(w):
        s = _longest(w.text, _ES_Y, w.rv)
        if s and w.text[: -len(s)].endswith("u"):
            w.text = w.text[: -len(s)]
        else:
            s = _longest(w.text, ["en", "es", "éis", "emos", *_ES_VERB], w.rv)
            if s:
                w.text = w.text[: -len(s)]
                if s in ("en", "es", "éis", "emos") and w.text.endswith("gu"):
                    w.text = w.text[:-1]
    s = _longest(w.text, ("os", "a", "o", "á", "í", "ó", "e", "é"), w.rv)
    if s:
        w.text = w.text[: -len(s)]
        if s in ("e", "é") and w.text.endswith("gu") and len(w.text) - 1 >= w.rv:
            w.text = w.text[:-1]
    return w.text.translate(_ACUTE)


def _es_standard(w: _Word) -> bool:
    return _standard(w, _ES_STANDARD)


_IT_V = "aeiouàèìòù"
#: Fixed values of the published rules.
_IT_PRONOUN = """ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene
vela vele veli velo vene""".split()
_IT_STANDARD: _Standard = [
    ("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti", "r2", "", ()),
    ("azione azioni atore atori", "r2", "", (("ic",),)), ("logia logie", "r2", "log", ()), ("uzione uzioni usione usioni", "r2", "u", ()), ("enza enze", "r2", "ente", ()),
    ("amento amenti imento imenti", "rv", "", ()), ("amente", "r1", "", (("iv", "os", "ic", "abil"), ("at",))), ("ità", "r2", "", (("abil", "ic", "iv"),)),
    ("ivo ivi iva ive", "r2", "", (("at",),)),
]
_IT_VERB = """ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero
erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste
iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir""".split()


def italian(word: str) -> str:
    text = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    text = re.sub(f"(?<=[{_IT_V}])([ui])(?=[{_IT_V}])", lambda m: m.group(1).upper(), text)
    w = _Word(text, _IT_V)
    s = _longest(w.text, _IT_PRONOUN)
    if s:
        rest = w.text[: -len(s)]
        e = _longest(rest, ("ando", "endo", "ar", "er", "ir"), w.rv)
        if e:
            w.text = rest if len(e) > 2 else rest + "e"
    if not _standard(w, _IT_STANDARD):
        w.drop([_longest(w.text, _IT_VERB, w.rv) or "\0"], w.rv)
    if w.drop("a e i o à è ì ò".split(), w.rv):
        w.drop(("i",), w.rv)
    if w.text.endswith(("ch", "gh")) and len(w.text) - 1 >= w.rv:
        w.text = w.text[:-1]
    return w.text.replace("U", "u").replace("I", "i")


_PT_V = "aeiouáéíóúâêô"
#: Fixed values of the published rules.
_PT_STANDARD: _Standard = [
    ("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância", "r2", "", ()),
    ("logia logias", "r2", "log", ()), ("uça~o uço~es", "r2", "u", ()), ("ência ências", "r2", "ente", ()),
    ("amente", "r1", "", (("iv", "os", "ic", "ad"), ("at",))), ("mente", "r2", "", (("ante", "avel", "ível"),)), ("idade idades", "r2", "", (("abil", "ic", "iv"),)),
    ("iva ivo ivas ivos", "r2", "", (("at",),)),
]
_PT_VERB = """ada ida ia aria eria iria ará ara erá irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem
irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás irás avas es ardes erdes irdes ares eres ires
asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos
eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras""".split()


def portuguese(word: str) -> str:
    w = _Word(word.replace("ã", "a~").replace("õ", "o~"), _PT_V)
    changed = _standard(w, _PT_STANDARD)
    if not changed and w.text.endswith(("eira", "eiras")) and len(w.text) - (3 if w.text.endswith("a") else 4) >= w.rv:
        w.text, changed = w.text[: w.text.rindex("ira")] + "ir", True
    if not changed:
        s = _longest(w.text, _PT_VERB, w.rv)
        if s:
            w.text, changed = w.text[: -len(s)], True
    if changed:
        if w.text.endswith("ci") and len(w.text) - 1 >= w.rv:
            w.text = w.text[:-1]
    else:
        w.drop("os a i o á í ó".split(), w.rv)
    s = _longest(w.text, ("e", "é", "ê"), w.rv)
    if s:
        w.text = w.text[:-1]
        if w.text.endswith(("gu", "ci")) and len(w.text) - 1 >= w.rv:
            w.text = w.text[:-1]
    elif w.text.endswith("ç"):
        w.text = w.text[:-1] + "c"
    return w.text.replace("a~", "ã").replace("o~", "õ")


_FR_V = "aeiouyâàëéêèïîôûù"
#: Fixed values of the published rules.
_FR_VERB_I = """îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes
issants isse issent isses issez issiez issions issons it""".split()
_FR_VERB_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_VERB_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(word: str) -> str:
    v = _FR_V
    t = word.replace("qu", "qU")
    t = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m.group(1).upper(), t)
    t = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", t)
    w = _Word(t, v)
    if t[:3] in ("par", "col", "tap") or len(t) > 1 and t[0] in v and t[1] in v:
        w.rv = min(3, len(t))
    else:
        w.rv = next((i + 1 for i in range(1, len(t)) if t[i] in v), len(t))
    changed, again = _fr_standard(w)
    if not changed or again:
        s = _longest(w.text, _FR_VERB_I, w.rv)
        if s and len(w.text) - len(s) - 1 >= w.rv and w.text[-len(s) - 1] not in v:
            w.text, changed = w.text[: -len(s)], True
        else:
            e = _longest(w.text, [*_FR_VERB_E, *_FR_VERB_A, "ions"], w.rv)
            if e == "ions":
                if len(w.text) - 4 >= w.r2:
                    w.text, changed, again = w.text[:-4], True, False
            elif e:
                w.text, changed, again = w.text[: -len(e)], True, False
                if e in _FR_VERB_A and w.text.endswith("e") and len(w.text) - 1 >= w.rv:
                    w.text = w.text[:-1]
    if changed:
        if w.text.endswith("Y"):
            w.text = w.text[:-1] + "i"
        elif w.text.endswith("ç"):
            w.text = w.text[:-1] + "c"
    else:
        if w.text.endswith("s") and w.text[-2:-1] not in tuple("aiouès"):
            w.text = w.text[:-1]
        s = _longest(w.text, ("ion", "ier", "ière", "Ier", "Ière", "e"), w.rv)
        if s == "ion":
            if len(w.text) - 3 >= w.r2 and w.text[-4:-3] in ("s", "t") and len(w.text) - 4 >= w.rv:
                w.text = w.text[:-3]
        elif s == "e":
            w.text = w.text[:-1]
        elif s:
            w.text = w.text[: -len(s)] + "i"
    if w.text.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.text = w.text[:-1]
    m = re.search(f"[éè]([^{v}]+)$", w.text)
    if m:
        w.text = w.text[: m.start()] + "e" + m.group(1)
    return w.text.replace("I", "i").replace("U", "u").replace("Y", "y")


def _fr_standard(w: _Word) -> tuple[bool, bool]:
    """Standard endings: whether the word changed, and whether verb endings are to be tried all the same."""
    v, x = _FR_V, w.text
    rules = {
        "ance iqUe isme able iste eux ances iqUes ismes ables istes": "a", "atrice ateur ation atrices ateurs ations": "b", "logie logies": "c", "usion ution usions utions": "d",
        "ence ences": "e", "ement ements": "f", "ité ités": "g", "if ive ifs ives": "h", "eaux": "i", "aux": "j", "euse euses": "k", "issement issements": "l",
        "amment": "m", "emment": "n", "ment ments": "o",
    }
    found = max(((s, k) for ss, k in rules.items() for s in ss.split() if x.endswith(s)), key=lambda f: len(f[0]), default=None)
    if found is None:
        return False, False
    s, kind = found
    at = len(x) - len(s)
    in_r1, in_r2, in_rv = at >= w.r1, at >= w.r2, at >= w.rv
    rest = x[:at]

    def in_region(n: int, region: int) -> bool:
        return len(w.text) - n >= region

    if kind in "abcdegh" and not in_r2 or kind in "fmn" and not in_rv or kind in "jl" and not in_r1:
        return False, False
    if kind == "a":
        w.text = rest
    elif kind == "b":
        w.text = rest
        if rest.endswith("ic"):
            w.text = rest[:-2] if in_region(2, w.r2) else rest[:-2] + "iqU"
    elif kind in "cde":
        w.text = rest + {"c": "log", "d": "u", "e": "ent"}[kind]
    elif kind == "f":
        w.text = rest
        if rest.endswith("iv") and in_region(2, w.r2):
            w.text = rest[:-2]
            if w.text.endswith("at") and in_region(2, w.r2):
                w.text = w.text[:-2]
        elif rest.endswith("eus"):
            w.text = rest[:-3] if in_region(3, w.r2) else rest[:-1] + "x" if in_region(3, w.r1) else rest
        elif rest.endswith(("abl", "iqU")) and in_region(3, w.r2):
            w.text = rest[:-3]
        elif rest.endswith(("ièr", "Ièr")) and in_region(3, w.rv):
            w.text = rest[:-3] + "i"
    elif kind == "g":
        w.text = rest
        if rest.endswith("abil"):
            w.text = rest[:-4] if in_region(4, w.r2) else rest[:-2] + "l"
        elif rest.endswith("ic"):
            w.text = rest[:-2] if in_region(2, w.r2) else rest[:-2] + "iqU"
        elif rest.endswith("iv") and in_region(2, w.r2):
            w.text = rest[:-2]
    elif kind == "h":
        w.text = rest
        if rest.endswith("at") and in_region(2, w.r2):
            w.text = rest[:-2]
            if w.text.endswith("ic"):
                w.text = w.text[:-2] if in_region(2, w.r2) else w.text[:-2] + "iqU"
    elif kind == "i":
        w.text = rest + "eau"
    elif kind == "j":
        w.text = rest + "al"
    elif kind == "k":
        if not in_r2 and not in_r1:
            return False, False
        w.text = rest if in_r2 else rest + "eux"
    elif kind == "l":
        if not rest or rest[-1] in v:
            return False, False
        w.text = rest
    elif kind == "m":
        w.text = rest + "ant"
        return True, True
    elif kind == "n":
        w.text = rest + "ent"
        return True, True
    else:
        if not rest or rest[-1] not in v or at - 1 < w.rv:
            return False, False
        w.text = rest
        return True, True
    return True, False


# --- Dutch -----------------------------------------------------------------------------------------------------------


def dutch(word: str) -> str:
    v = "aeiouyè"
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(f"(?<=[{v}])y", "Y", "Y" + w[1:] if w[:1] == "y" else w)
    w = re.sub(f"(?<=[{v}])i(?=[{v}])", "I", w)
    r1, r2 = _regions(w, v)
    r1 = max(r1, min(3, len(w)))

    def undouble(x: str) -> str:
        return x[:-1] if x.endswith(("kk", "dd", "tt")) else x

    def without_en(x: str, s: str) -> str:
        rest = x[: -len(s)]
        fits = len(rest) >= r1 and rest[-1:] not in tuple(v) and not rest.endswith("gem")
        return undouble(rest) if fits and rest else x

    def without_e(x: str) -> tuple[str, bool]:
        rest = x[:-1]
        if x.endswith("e") and len(rest) >= r1 and rest[-1:] not in tuple(v):
            return undouble(rest), True
        return x, False

    s = _longest(w, ("heden", "en", "ene", "s", "se"))
    if s == "heden" and len(w) - 5 >= r1:
        w = w[:-5] + "heid"
    elif s in ("en", "ene"):
        w = without_en(w, s)
    elif s in ("s", "se"):
        rest = w[: -len(s)]
        if len(rest) >= r1 and rest[-1:] not in tuple(v + "j"):
            w = rest
    w, dropped = without_e(w)
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = without_en(w, "en")
    s = _longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if s and len(w) - len(s) >= r2:
        rest = w[: -len(s)]
        if s in ("end", "ing"):
            w = rest[:-2] if rest.endswith("ig") and len(rest) - 2 >= r2 and not rest.endswith("eig") else undouble(rest)
        elif s == "ig":
            w = w if rest.endswith("e") else rest
        elif s == "lijk":
            w = without_e(rest)[0]
        elif s == "baar" or dropped:
            w = rest
    w = re.sub(f"([^{v}I])(aa|ee|oo|uu)([^{v}I])$", lambda m: m.group(1) + m.group(2)[0] + m.group(3), w)
    return w.replace("I", "i").replace("Y", "y")


BUILT: dict[str, Callable[[str], str]] = {
    "porter": porter, "english": english, "swedish": swedish, "norwegian": norwegian, "danish": danish, "german": german, "russian": russian,
    "spanish": spanish, "italian": italian, "portuguese": portuguese, "dutch": dutch, "french": french,
    "finnish": finnish, "hungarian": hungarian, "romanian": romanian, "indonesian": indonesian, "irish": irish, "hindi": hindi, "nepali": nepali, "lithuanian": lithuanian, "arabic": arabic,
}


def stemmer(name: str, charset: str | None = None) -> Callable[[str | bytes], str]:
    """The stemmer of an algorithm name or language code; bytes are decoded by ``charset`` (UTF-8 if none)."""
    key = next((k for k, codes in ALGORITHMS.items() if name == k or name in codes), None)
    if key is None:
        raise ValueError(f"no such algorithm: {name}")
    if key not in BUILT:
        raise NotImplementedError(f"{key} is listed but not built")
    rule = BUILT[key]
    return lambda word: rule(word.decode(charset or "utf-8") if isinstance(word, bytes) else word)


def stem_with(token: Column, name: str) -> Column:
    """Stems of a token column by any built algorithm."""
    stemmer(name)

    @F.pandas_udf(T.StringType())
    def run(tokens: pd.Series) -> pd.Series:
        rule, memory = stemmer(name), {}
        return tokens.map(lambda t: None if t is None else memory[t] if t in memory else memory.setdefault(t, rule(t)))

    return run(token)
