"""Finnish, Hungarian, Romanian, Indonesian, Irish, Hindi, Nepali, Lithuanian and Arabic stemmers by their published rules.

The suffix tables are fixed values of these rules; words are expected in lower case and composed form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Starts of R1 and R2: behind the first non-vowel that follows a vowel, and the same again."""
    step = re.compile(f"[^{vowels}]*[{vowels}]+[^{vowels}]")
    first = step.match(word)
    second = step.match(word, first.end()) if first else None
    return first.end() if first else len(word), second.end() if second else len(word)


def _suffix(word: str, suffixes: Iterable[str], start: int = 0, fits: Callable[[str, str], bool] | None = None) -> str:
    """The longest suffix that begins at ``start`` or later and, if asked, fits what stands before it; '' if none."""
    found = [s for s in suffixes if word.endswith(s) and len(word) - len(s) >= start and (fits is None or fits(word[: -len(s)], s))]
    return max(found, key=len, default="")


def _without(word: str, suffix: str) -> str:
    return word[: len(word) - len(suffix)]


# --- Finnish ---------------------------------------------------------------------------------------------------------

_FI_V1, _FI_V2, _FI_C = "aeiouyäö", "aeiouäö", "bcdfghjklmnpqrstvwxz"
#: Particles, what possessive endings follow, cases and further endings.
_FI_PARTICLES = "kin kaan kään ko kö han hän pa pä sti".split()
_FI_POSSESSIVES = "si ni nsa nsä mme nne an än en".split()
_FI_BEFORE = {"an": ("ta", "ssa", "sta", "lla", "lta", "na"), "än": ("tä", "ssä", "stä", "llä", "ltä", "nä"), "en": ("lle", "ine")}
_FI_CASES = "han hen hin hon hän hön siin den tten seen a ä tta ttä ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine n".split()
_FI_OTHERS = "mpi mpa mpä mmi mma mmä impi impa impä immi imma immä eja ejä".split()
_FI_LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")


def _fi_case_fits(rest: str, case: str) -> bool:
    if case in ("han", "hen", "hin", "hon", "hän", "hön"):
        return rest.endswith(case[1])
    if case in ("siin", "den", "tten"):
        return len(rest) > 1 and rest[-1] == "i" and rest[-2] in _FI_V2
    if case == "seen":
        return rest.endswith(_FI_LONG)
    if case in ("a", "ä"):
        return len(rest) > 1 and rest[-1] in _FI_V1 and rest[-2] in _FI_C
    return rest.endswith("e") if case in ("tta", "ttä") else True


def finnish(word: str) -> str:
    p1, p2 = _regions(word, _FI_V1)
    w = word
    s = _suffix(w, _FI_PARTICLES, p1)
    if s and (len(w) - 3 >= p2 if s == "sti" else _without(w, s)[-1:] in tuple(_FI_V1 + "nt")):
        w = _without(w, s)
    s = _suffix(w, _FI_POSSESSIVES, p1)
    rest = _without(w, s)
    if s == "ni":
        w = rest[:-3] + "ksi" if rest.endswith("kse") else rest
    elif s and not (s == "si" and rest.endswith("k")) and (s not in _FI_BEFORE or rest.endswith(_FI_BEFORE[s])):
        w = rest
    s = _suffix(w, _FI_CASES, p1, lambda rest, case: _fi_case_fits(rest, case) or case not in ("siin", "den", "tten", "seen"))
    ended = bool(s) and _fi_case_fits(_without(w, s), s)
    if ended:
        w = _without(w, s)
        if s == "n" and w.endswith((*_FI_LONG, "ie")):
            w = w[:-1]
    s = _suffix(w, _FI_OTHERS, p2)
    if s and (len(s) == 4 or s in ("eja", "ejä") or not _without(w, s).endswith("po")):
        w = _without(w, s)
    if ended:
        if w.endswith(("i", "j")) and len(w) - 1 >= p1:
            w = w[:-1]
    elif w.endswith("t") and len(w) - 1 >= p1 and w[-2:-1] in tuple(_FI_V1) and len(w) - 2 >= p1:
        w = w[:-1]
        s = _suffix(w, ("mma", "imma"), p2)
        if s and (s == "imma" or not w[:-3].endswith("po")):
            w = _without(w, s)
    if w.endswith(_FI_LONG) and len(w) - 2 >= p1:
        w = w[:-1]
    if len(w) - 2 >= p1 and w[-1:] in tuple("aäei") and w[-2:-1] in tuple(_FI_C):
        w = w[:-1]
    if w.endswith(("oj", "uj")) and len(w) - 2 >= p1:
        w = w[:-1]
    if w.endswith("jo") and len(w) - 2 >= p1:
        w = w[:-1]
    last = next((i for i in range(len(w) - 1, p1 - 1, -1) if w[i] not in _FI_V1), -1)
    if last > 0 and w[last] == w[last - 1] and w[last] in _FI_C:
        w = w[:last] + w[last + 1 :]
    return w


# --- Hungarian -------------------------------------------------------------------------------------------------------

_HU_V = "aeiouáéíóöőúüű"
#: Letters of more than one sign, doubled letters, and the endings in the order in which they are taken.
_HU_LETTERS = ("dzs", "cs", "gy", "ly", "ny", "sz", "ty", "zs")
_HU_DOUBLED = tuple("bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs".split())
_HU_CASES = """ba ra be re ig nak nek val vel ul ből ről től nál nél ból ról tól ül n an ban en ben képpen on ön képp kor t at et ként anként enként onként ot ért öt
hez hoz höz vá vé""".split()
_HU_RULES: list[dict[str, str]] = [
    {"én": "e", "án": "a", "ánként": "a"},
    {"stul": "", "astul": "", "stül": "", "estül": "", "ástul": "a", "éstül": "e"},
    {"á": "doubled", "é": "doubled"},
    {s: "" for s in "éi é ké aké eké oké öké".split()} | {s: "a" for s in "áéi áké".split()} | {s: "e" for s in "ééi éké éé".split()},
    {s: "" for s in "a ja d ad ed od öd e je nk unk ünk uk juk ük jük m am em om o".split()}
    | {s: "a" for s in "ád ánk ájuk ám á".split()} | {s: "e" for s in "éd énk éjük ém é".split()},
    {s: "" for s in "id aid jaid eid jeid i ai jai ei jei itek eitek jeitek ik aik jaik eik jeik ink aink jaink eink jeink aitok jaitok im aim jaim eim jeim".split()}
    | {s: "a" for s in "áid ái áik áink áitok áim".split()} | {s: "e" for s in "éid éi éitek éik éink éim".split()},
    {"k": "", "ak": "", "ek": "", "ok": "", "ök": "", "ák": "a", "ék": "e"},
]


def hungarian(word: str) -> str:
    r1 = len(word)
    if word[:1] in tuple(_HU_V):
        at = next((i for i, c in enumerate(word) if c not in _HU_V), None)
        if at is not None:
            r1 = at + next((len(x) for x in _HU_LETTERS if word.startswith(x, at)), 1)
    else:
        at = next((i for i, c in enumerate(word) if c in _HU_V), None)
        r1 = len(word) if at is None else at + 1

    def single(rest: str) -> str:
        return rest[:-2] + rest[-1]

    w = word
    if w.endswith(("al", "el")) and len(w) - 2 >= r1 and w[:-2].endswith(_HU_DOUBLED):
        w = single(w[:-2])
    s = _suffix(w, _HU_CASES, 0)
    if s and len(w) - len(s) >= r1:
        w = _without(w, s)
        if w.endswith(("á", "é")) and len(w) - 1 >= r1:
            w = w[:-1] + ("a" if w[-1] == "á" else "e")
    for rules in _HU_RULES:
        s = _suffix(w, rules, 0)
        if s and len(w) - len(s) >= r1:
            if rules[s] != "doubled":
                w = _without(w, s) + rules[s]
            elif w[:-1].endswith(_HU_DOUBLED):
                w = single(w[:-1])
    return w


# --- Romanian --------------------------------------------------------------------------------------------------------

_RO_V = "aeiouâîă"
#: Endings by what replaces them.
_RO_PLURAL = {"a": "aua", "e": "ea ele elor", "i": "ii iua iei iile iilor ilor", "": "ul ului", "at": "atei", "aţi": "aţie aţia", "ile": "ile"}
_RO_COMBINED = {
    "abil": "abilitate abilitati abilităi abilităţi", "ibil": "ibilitate", "iv": "ivitate ivitati ivităi ivităţi",
    "ic": "icala iciva icale icitate icive icali icatori icitati icivi icităi icităţi ical icator iciv icală icivă",
    "at": "ativa aţiune atoare ătoare ative atori ători ativi ator ător ativ ativă", "it": "itiva iţiune itoare itive itori itivi itor itiv itivă",
}
_RO_STANDARD = {
    "": """ica abila ibila oasa ata ita anta uta iva ic ice abile ibile oase ate itate ite ante ute ive ici abili ibili atori osi ati itati iti anti uti ivi ităi oşi ităţi
    abil ibil ator os at it ant ut iv ică abilă ibilă oasă ată ită antă ută ivă""",
    "ist": "ista isme iste isti işti ism ist istă", "t": "iune iuni",
}
_RO_VERB_AFTER = """ea ia esc ăsc ind ând are ere ire âre ase ise use âse eşte ăşte eze ai eai iai eşti ăşti ui ezi aşi aseşi iseşi useşi âseşi işi uşi âşi âi eaţi iaţi arăţi
aserăţi iserăţi userăţi âserăţi irăţi urăţi ârăţi am eam iam asem isem usem âsem arăm aserăm iserăm userăm âserăm irăm urăm ârăm au eau iau indu ându ez ească ară aseră iseră
useră âseră iră ură âră ează""".split()
_RO_VERB = "se sese sei seşi seseşi aţi eţi iţi serăţi seserăţi âţi em sesem im ăm serăm seserăm âm seră seseră".split()


def _ro_table(rules: dict[str, str]) -> dict[str, str]:
    return {s: by for by, some in rules.items() for s in some.split()}


_RO_PLURAL_, _RO_COMBINED_, _RO_STANDARD_ = map(_ro_table, (_RO_PLURAL, _RO_COMBINED, _RO_STANDARD))


def romanian(word: str) -> str:
    v = _RO_V
    w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m.group(1).upper(), word)
    r1, r2 = _regions(w, v)
    rv = len(w)
    if len(w) > 2:
        if w[0] not in v and w[1] in v:
            rv = 3
        else:
            searched = range(2, len(w))
            rv = next((i + 1 for i in searched if (w[i] in v) == (w[1] not in v)), len(w))
    s = _suffix(w, _RO_PLURAL_)
    if s and len(w) - len(s) >= r1 and not (s == "ile" and _without(w, s).endswith("ab")):
        w = _without(w, s) + ("i" if s == "ile" else _RO_PLURAL_[s])
    changed = False
    while True:
        s = _suffix(w, _RO_COMBINED_)
        if not s or len(w) - len(s) < r1:
            break
        w, changed = _without(w, s) + _RO_COMBINED_[s], True
    s = _suffix(w, _RO_STANDARD_)
    if s and len(w) - len(s) >= r2 and (s not in ("iune", "iuni") or _without(w, s).endswith("ţ")):
        w, changed = (_without(w, s)[:-1] + "t" if s in ("iune", "iuni") else _without(w, s) + _RO_STANDARD_[s]), True
    if not changed:
        s = _suffix(w, [*_RO_VERB_AFTER, *_RO_VERB], rv)
        at = len(w) - len(s) - 1
        if s and (s in _RO_VERB or at >= rv and (w[at] not in v or w[at] == "u")):
            w = _without(w, s)
    s = _suffix(w, ("a", "e", "i", "ie", "ă"))
    if s and len(w) - len(s) >= rv:
        w = _without(w, s)
    return w.replace("I", "i").replace("U", "u")


# --- Indonesian ------------------------------------------------------------------------------------------------------


def indonesian(word: str) -> str:
    v = "aeiou"
    w, measure, prefix = word, sum(c in v for c in word), 0
    if measure <= 2:
        return w
    for suffixes in (("kah", "lah", "pun"), ("nya", "ku", "mu")):
        if w.endswith(suffixes):
            w, measure = w[: -len(_suffix(w, suffixes))], measure - 1
            if measure <= 2:
                return w

    def suffix_dropped() -> bool:
        nonlocal w, measure
        fits = {"kan": prefix not in (2, 3), "an": prefix != 1, "i": prefix <= 2 and w[-2:-1] != "s"}
        s = _suffix(w, fits, 0, lambda rest, s: fits[s])
        if measure <= 2 or not s:
            return False
        w, measure = _without(w, s), measure - 1
        return True

    def first_prefix() -> bool:
        nonlocal w, measure, prefix
        for head, kind, put in (("meny", 1, "s"), ("peny", 3, "s"), ("meng", 1, ""), ("peng", 3, ""), ("mem", 1, "p"), ("pem", 3, "p"), ("men", 1, ""), ("ter", 1, ""), ("pen", 3, ""), ("me", 1, ""), ("di", 1, ""), ("ke", 3, "")):
            rest = w[len(head) :]
            if w.startswith(head) and (put != "s" or rest[:1] in tuple(v)):
                w, measure, prefix = (put if put and rest[:1] in tuple(v) else "") + rest, measure - 1, kind
                return True
        return False

    def second_prefix() -> bool:
        nonlocal w, measure, prefix
        for head, kind, put in (("pelajar", None, "ajar"), ("belajar", 4, "ajar"), ("ber", 4, ""), ("per", 2, ""), ("be", 4, ""), ("pe", 2, "")):
            rest = w[len(head) :]
            if w.startswith(head) and (head != "be" or rest[1:3] == "er" and rest[0] not in v):
                w, measure, prefix = put + rest, measure - 1, prefix if kind is None else kind
                return True
        return False

    if first_prefix():
        if suffix_dropped() and measure > 2:
            second_prefix()
    else:
        second_prefix()
        suffix_dropped()
    return w


# --- Irish -----------------------------------------------------------------------------------------------------------

#: Initial mutations with the letter behind them, and endings by region and replacement.
_GA_INITIAL = {
    "h-": "", "n-": "", "t-": "", "d'": "", "m'": "", "b'": "", "d'fh": "f", "bhf": "f", "fh": "f", "sh": "s", "ts": "s", "mb": "b", "bh": "b", "gc": "c", "ch": "c",
    "nd": "d", "dh": "d", "ng": "g", "gh": "g", "bp": "p", "ph": "p", "dt": "t", "th": "t", "mh": "m",
}
_GA_NOUN = [("r1", "", "amh eamh abh eabh aibh ibh aimh imh íocht aíocht íochta aíochta"), ("r2", "", "ire aire irí airí")]
_GA_DERIVED = [
    ("r2", "", "acht eacht ach each achta eachta achtúil eachtúil"), ("", "arc", "arcacht arcachta arcachtaí"), ("", "gin", "gineach gineas ginis"),
    ("", "graf", "grafaíocht grafaíochta grafaíochtaí grafaíoch"), ("", "paite", "paite patach pataigh patacha"), ("", "óid", "óideach óideacha óidigh"),
]
_GA_VERB = [("rv", "", "imid aimid ímid aímid faidh fidh"), ("r1", "", "ain eadh adh áil tear tar")]


def irish(word: str) -> str:
    head = next((x for x in sorted(_GA_INITIAL, key=len, reverse=True) if word.startswith(x)), None)
    w = word if head is None else _GA_INITIAL[head] + word[len(head) :]
    v = "aeiouáéíóú"
    r1, r2 = _regions(w, v)
    start = {"": 0, "r1": r1, "r2": r2, "rv": next((i + 1 for i, c in enumerate(w) if c in v), len(w))}
    for rules in (_GA_NOUN, _GA_DERIVED, _GA_VERB):
        best = max(((s, r) for r in rules for s in r[2].split() if w.endswith(s)), key=lambda x: len(x[0]), default=None)
        if best and len(w) - len(best[0]) >= start[best[1][0]]:
            w = _without(w, best[0]) + best[1][1]
    return w


# --- Hindi and Nepali ------------------------------------------------------------------------------------------------

#: Endings, and endings that must follow a consonant.
_HI = """ी ूंगी ेंगी ऊंगी आऊंगी ाऊंगी एंगी आएंगी ाएंगी ेगी ोगी एगी आएगी ाएगी ओगी आओगी ाओगी अती आती ाती अनी आँ ाँ इयाँ आइयाँ ाइयाँ ियाँ ु ीं अतीं आतीं ातीं आं ुआं उआं ें ईं आईं ाईं
ों इयों आइयों ाइयों ियों एं ुएं आएं उएं ाएं अताएं अनाएं ओं ुओं आओं उओं ाओं अताओं अनाओं ां इयां आइयां ाइयां ियां ू अ आ इ े ेंगे एंगे आएंगे ाएंगे ोगे ओगे आओगे ाओगे अते आते ाते अने आने ाने ई आई ाई
उ ऊ ो ् ए आए इए आइए ाइए ाए िए ओ आओ ाओ अकर आकर ाकर ा ूंगा ऊंगा आऊंगा ाऊंगा ेगा एगा आएगा ाएगा अता आता ाता अना आना ाना आया ाया ि""".split()
_HI_AFTER_CONSONANT = "ती नी तीं ताएं नाएं ताओं नाओं ते ने कर ता ना".split()
_HI_CONSONANT = re.compile("[क-ह़क़-य़]$")
_HI_ALL = frozenset([*_HI, *_HI_AFTER_CONSONANT])


def hindi(word: str) -> str:
    """The first letter is never part of an ending."""
    return _without(word, _suffix(word, _HI_ALL, 1, lambda rest, s: s not in _HI_AFTER_CONSONANT or bool(_HI_CONSONANT.search(rest, 1))))


_NE_FIRST = "लाइ ले लाई सँगै मै सँग संग मार्फत रत मा द्वारा पछि".split()
_NE_FIRST_NOT_AFTER_E = "की कै को का कि".split()
_NE_BEFORE_NASAL = ("यौ", "छौ", "नौ", "थे")
_NE_LAST = """ेकी एकी इएकी िएकी देखी थी दी छु ेछु नेछु एछु नु हरु हरू छे थे ने ेकै नेकै एकै दै इदै िदै ेको नेको एको इएको िएको दो इदो िदो यो इयो थ्यो भयो ियो थियो दियो छौ इछौ ेछौ नेछौ एछौ िछौ यौ
छ्यौ थ्यौ थियौ छन् इछन् ेछन् नेछन् एछन् िछन् लान् छिन् थिन् पर् इस् थिइस् छेस् होस् छस् इछस् ेछस् नेछस् एछस् िछस् िस् थिस् थिए छ इछ ेछ नेछ हुनेछ हुन्छ इन्छ िन्छ एछ िछ ेका नेका एका इएका िएका दा
इदा िदा देखि माथि""".split()


def nepali(word: str) -> str:
    s = _suffix(word, [*_NE_FIRST, *_NE_FIRST_NOT_AFTER_E])
    rest = _without(word, s)
    w = word if s in _NE_FIRST_NOT_AFTER_E and rest.endswith(("ए", "े")) else rest
    while True:
        if w.endswith(("ँ", "ं")) and w[:-1].endswith(_NE_BEFORE_NASAL) or w.endswith("त्रै"):
            w = w[:-1]
        s = _suffix(w, _NE_LAST)
        if not s:
            return w
        w = _without(w, s)


# --- Lithuanian ------------------------------------------------------------------------------------------------------

_LT_V = "aeiyouąęėįųū"
#: Endings, then further suffixes, and forms that are brought to their noun first.
_LT_ENDINGS = """a ia eria osna iosna uosna iuosna ysna ėsna e ie enie erie oje ioje uje iuje yje enyje eryje ėje ame iame sime ome ėme tumėme ose iose uose iuose yse enyse eryse
ėse ate iate ite kite site ote tute ėte tumėte i ai iai eriai ei tumei ki imi erimi umi iumi si asi iasi esi iesi siesi isi aisi eisi tumeisi uisi osi ėjosi uosi iuosi siuosi usi
ausi čiausi ąsi ėsi ųsi tųsi ti enti inti oti ioti uoti iuoti auti iauti yti ėti telėti inėti terėti ui iui eniui oj ėj k am iam iem im sim om tum ėm tumėm an on ion un iun ėn o
io enio ėjo uo s as ias es ies is ais iais tumeis imis enimis omis iomis umis ėmis enis asis ysis ams iams iems ims enims erims oms ioms ums ėms ens os ios uos iuos ers us aus
iaus ius ys enys erys ąs iąs ės amės iamės imės kimės simės omės ėmės tumėmės atės iatės sitės otės ėtės tumėtės ūs įs tųs at iat it sit ot ėt tumėt u au iau čiau iu eniu siu y
ą ią ė ę į enį erį ų ių erų""".split()
_LT_SUFFIXES = """ing aj iaj iej oj ioj uoj iuoj auj ąj iąj ėj ųj iųj ok iok iuk uliuk učiuk išk iul yl ėl am dam jam zgan ain esn op iop ias ies ais iais os ios uos iuos aus iaus ąs
iąs ęs utėait ant iant siant int ot uot iuot yt ėt ykšt iau dav sv šv ykšč ę ėję""".split()
_LT_FORMS = {
    "aite": "aitė", "aitės": "aitė", "uote": "uotė", "uotės": "uotė", "okate": "okatė", "okatės": "okatė", "ėjime": "ėjimas", "avime": "avimas", "ojime": "ojimas",
    "esiu": "esys", "asius": "asys",
}


def lithuanian(word: str) -> str:
    first = re.compile(f"[^{_LT_V}]*[{_LT_V}]+[^{_LT_V}]").match(word, 1 if word[:1] == "a" and len(word) > 6 else 0)
    p1 = first.end() if first else len(word)

    def hardened(w: str) -> str:
        return w[:-1] + "t" if w.endswith("č") else w[:-2] + "d" if w.endswith("dž") else w

    s = _suffix(word, _LT_FORMS)
    w = _without(word, s) + _LT_FORMS.get(s, "")
    w = hardened(_without(w, _suffix(w, _LT_ENDINGS, p1)))
    while s := _suffix(w, _LT_SUFFIXES, p1):
        w = _without(w, s)
    w = hardened(w)
    return w[:-1] if w.endswith("gd") else w


# --- Arabic ----------------------------------------------------------------------------------------------------------

#: Affixes with the least length of a word that loses them, and what takes the place of a prefix.
_AR_DEFINITE = {"بال": 5, "كال": 5, "ال": 4, "لل": 4}
_AR_NOUN_1A = {s: n for n, some in ((4, "ي ك ه"), (5, "نا كم ها هن هم"), (6, "كما هما")) for s in some.split()}
_AR_VERB_1 = {s: n for n, some in ((4, "ه ك"), (5, "ني نا ها هم هن كم كن"), (6, "هما كما كمو")) for s in some.split()}
_AR_VERB_2A = {s: n for n, some in ((4, "ت ا ن ي"), (5, "نا تا تن"), (6, "ان ون ين تما")) for s in some.split()}
_AR_NOUN_1B, _AR_NOUN_2A, _AR_NOUN_2B, _AR_NOUN_2C1, _AR_NOUN_2C2, _AR_NOUN_3 = {"ن": 6}, {"ا": 5, "ي": 5, "و": 5}, {"ات": 5}, {"ت": 4}, {"ة": 4}, {"ي": 3}
_AR_VERB_2B, _AR_VERB_2C = {"وا": 5, "تم": 5}, {"و": 4, "تمو": 6}
_AR_DOUBLED = {"أأ": "أ", "أؤ": "أ", "أآ": "آ", "أا": "ا", "أإ": "إ"}
_AR_FUTURE = {"سي": "ي", "ست": "ت", "سن": "ن", "سأ": "أ"}
_AR_MARKS = re.compile("[ـً-ْ]")
_AR_FORMS = re.compile("[ﹰ-ﻼ]")
_AR_DIGITS = {0x0660 + i: str(i) for i in range(10)}
_AR_SEATS = str.maketrans("آأإؤئ", "اااوي")


class _Arabic:
    """A word that loses affixes; each step tells whether it applied."""

    def __init__(self, word: str):
        sign = next((p for p in sorted(_AR_DEFINITE, key=len, reverse=True) if word.startswith(p)), None)
        self.definite = sign is not None and len(word) >= _AR_DEFINITE[sign]
        self.noun, self.verb = True, not self.definite
        plain = _AR_FORMS.sub(lambda m: unicodedata.normalize("NFKC", m.group()), _AR_MARKS.sub("", word))
        self.w = plain.translate(_AR_DIGITS)

    def end(self, rules: dict[str, int]) -> bool:
        s = _suffix(self.w, rules)
        if not s or len(self.w) < rules[s]:
            return False
        self.w = _without(self.w, s)
        return True

    def start(self, rules: dict[str, str], least: int) -> bool:
        s = max((p for p in rules if self.w.startswith(p)), key=len, default="")
        if not s or len(self.w) < least:
            return False
        self.w = rules[s] + self.w[len(s) :]
        return True

    def verb_ends(self) -> bool:
        if not self.verb:
            return False
        if self.end(_AR_VERB_1):
            while self.end(_AR_VERB_1):
                pass
            if self.end(_AR_VERB_2A) or self.end(_AR_VERB_2C) or self.w:
                return True
        return self.end(_AR_VERB_2B) or self.end(_AR_VERB_2A)

    def noun_ends(self) -> bool:
        if not self.noun:
            return False

        def plural(also_nothing: bool) -> bool:
            return self.end(_AR_NOUN_2A) or self.end(_AR_NOUN_2B) or self.end(_AR_NOUN_2C1) or also_nothing

        self.end(_AR_NOUN_2C2) or (
            not self.definite and self.end(_AR_NOUN_1A) and plural(bool(self.w))
            or self.end(_AR_NOUN_1B) and plural(False)
            or not self.definite and self.end(_AR_NOUN_2A)
            or self.end(_AR_NOUN_2B)
        )
        return self.end(_AR_NOUN_3)

    def begins(self) -> None:
        self.start(_AR_DOUBLED, 4)
        if not self.w.startswith(("فا", "وا")):
            self.start({"ف": "", "و": ""}, 4)
        sign = max((p for p in _AR_DEFINITE if self.w.startswith(p)), key=len, default="")
        if sign and len(self.w) > _AR_DEFINITE[sign]:
            self.w = self.w[len(sign) :]
            return
        if self.noun and not self.w.startswith("با") and self.start({"ب": "", "بب": "ب", "كك": "ك"}, 4):
            return
        if self.verb:
            self.start(_AR_FUTURE, 5)
            self.start({"يست": "است", "نست": "است", "تست": "است"}, 5)


def arabic(word: str) -> str:
    a = _Arabic(word)
    if not a.verb_ends() and not a.noun_ends() and a.w.endswith("ى"):
        a.w = a.w[:-1] + "ي"
    a.begins()
    w = a.w[:-1] + "ء" if a.w.endswith(tuple("آأؤإئ")) else a.w
    return w.translate(_AR_SEATS)
