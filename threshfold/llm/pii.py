"""Personal information in free text: find it through its disguises, replace it by type.

Detection reads a normalised text and reports places in the source. The normalisers are
transducers that keep, for every character they write, the source character it came from:

1. homoglyphs (full-width forms, look-alike Cyrillic and Greek letters, odd blanks and dashes)
   become plain ones, zero-width characters vanish;
2. ``at`` and ``dot`` written out or bracketed become ``@`` and ``.`` where they join an address;
3. runs of at least seven spelled digits become digits.

Detectors then run from the most to the least distinctive type, and a later item inside an
earlier one is dropped: email, identity number, phone, address, name. Places are code points.

A name needs evidence beside its shape: a strong cue (a title, a label, a letter's closing, a
person spoken to, another item behind it), or a given name of the lexicon, or a surname that ends as surnames
of some languages do. Weak cues (verbs of what persons do, places of work) count only together with a
lexicon name, such a surname or initials. Words of companies and of markets beside it refuse.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshfold.session import spread

TYPES = ("email", "id_number", "phone", "address", "name")
FOUND = "src string, ingest_no long, pii_type string, span_start long, span_end long"

# Look-alike letters and signs, one to one.
_LOOKALIKE_FROM = "АВЕКМНОРСТХаеорсухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο    ‐‑‒–—−‘’ʼ․。"
_LOOKALIKE_TO = "ABEKMHOPCTXaeopcyxijsdABEZHIKMNOPTYXvo    ------'''.."
# Characters of no width.
_NO_WIDTH = re.compile("[­​-‏⁠﻿]")
# Spelled digits.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_TABLE = {ord(a): b for a, b in zip(_LOOKALIKE_FROM, _LOOKALIKE_TO, strict=True)}
_TABLE |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_TABLE |= {0x1D7CE + i: str(i % 10) for i in range(50)}


class Mapped:
    """A normalised text; ``pos[i]`` is the source place of its i-th character (None: the same)."""

    __slots__ = ("text", "pos", "size")

    def __init__(self, text: str) -> None:
        self.text, self.pos, self.size = text, None, len(text)

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replace spans; each written character maps to its span's start."""
        old, out, pos, at = self.text, [], [], 0
        src = self.pos if self.pos is not None else range(len(old))
        for a, z, new in edits:
            out += (old[at:a], new)
            pos += src[at:a]
            pos += [src[a]] * len(new)
            at = z
        out.append(old[at:])
        pos += src[at:]
        self.text, self.pos = "".join(out), pos

    def source(self, a: int, z: int) -> tuple[int, int]:
        if self.pos is None:
            return a, z
        return self.pos[a], (self.pos[z] if z < len(self.pos) else self.size)


_AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s*@\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
_JOINED = re.compile(rf"(?<=[\w+%-]){_AT}(?:[^\W_](?:[\w-]*[^\W_])?{_DOT})+[^\W\d_]{{2,}}\b", re.I)
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|dot)\s*[\])}>]|\s@|@\s", re.I)
_AT_ONLY, _DOT_ONLY = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_WORD = "(?:" + "|".join(_DIGITS) + ")"
_SPELLED = re.compile(rf"\b(?:(?:double\s+|triple\s+)?{_WORD}[\s,.-]+){{6,}}{_WORD}\b", re.I)


def _joined(m: re.Match) -> tuple[int, int, str] | None:
    whole = m[0]
    head = _AT_ONLY.match(whole)
    if "@" not in head[0] and not re.search(r"[\[({<]", head[0]) and not re.search(r"\bdot\b", whole, re.I):
        return None  # "look at brook.example" is no address
    return m.start(), m.end(), "@" + _DOT_ONLY.sub(".", whole[head.end() :])


def _digits(m: re.Match) -> tuple[int, int, str]:
    out, times = [], 1
    for w in re.findall(r"[a-z]+", m[0].lower()):
        if w in _DIGITS:
            out.append(_DIGITS[w] * times)
            times = 1
        else:
            times = 2 if w == "double" else 3
    return m.start(), m.end(), "".join(out)


def _disguised(low: str) -> bool:
    return ("dot" in low and "at" in low) or ((("at" in low and any(c in low for c in "[({<")) or "@" in low) and _BRACKETED.search(low) is not None)


def normalise(text: str) -> Mapped:
    plain = text.isascii()
    m = Mapped(text if plain else text.translate(_TABLE))
    if not plain and _NO_WIDTH.search(text):
        m.rewrite([(x.start(), x.end(), "") for x in _NO_WIDTH.finditer(m.text)])
    low = m.text.lower()
    if _disguised(low) and (edits := [e for x in _JOINED.finditer(m.text) if (e := _joined(x))]):
        m.rewrite(edits)
    if sum(map(low.count, _DIGITS)) >= 7 and (edits := [_digits(x) for x in _SPELLED.finditer(m.text)]):
        m.rewrite(edits)
    return m


# --- detectors: (start, end) in the normalised text ------------------------------------------

_EMAIL = re.compile(r"(?<![\w.+%'-])[\w.+%'-]{1,64}@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")

# Words that announce an identity number.
_ID_WORDS = (
    r"social security(?: (?:number|no\.?|#))?|ssn|soc sec|national insurance(?: (?:number|no\.?))?|ni (?:number|no\.?)|nino|insurance (?:number|no\.?)|"
    r"passport(?: (?:number|no\.?|#))?|passeport|pasaporte|reisepass(?:nummer)?|tax(?:payer)? (?:id|number|no\.?|ref(?:erence)?|identification number)|tin|itin|"
    r"steuer-?id(?:entifikationsnummer)?|steuernummer|dni|nie|nif|national id(?:entity)?(?: (?:number|card|no\.?))?|identity (?:number|card|no\.?)|id (?:number|card|no\.?)|personalausweis(?:nummer)?"
)
_ID_LABEL = re.compile(rf"\b(?:{_ID_WORDS})\b\.?(?:\s+(?:is|number|no\.?))?[\s:#=(\"']*", re.I)
_ID_VALUE = re.compile(r"[A-Za-z]{1,3}[ -]?\d(?:[ .\-/]?\d){4,13}(?:[ -]?[A-Za-z]\b(?!\.))?|\d(?:[ .\-/]?\d){4,13}(?:-?[A-Za-z]\b)?")
_ID_SHAPE = re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-[A-Z])(?![\w-])")

_PHONE = re.compile(
    r"(?<![\w.,$€£%/#-])(?:"
    r"(?:\+|00)\d{1,3}[\s.\-]?(?:\(\d{1,4}\)[\s.\-/]?)?\d{1,5}(?:[\s.\-/]{1,3}\d{2,8}){0,5}"  # international
    r"|\+?1?[\s.\-]{0,3}\(\d{3}\)\s?\d{3}[\s.\-]{1,3}\d{4}"  # (303) 555-0163, +1(303)555-0127
    r"|(?:1[\s.\-]{1,3})?[2-9]\d{2}(?P<sep>[\s.\-]{1,3})[2-9]\d{2}(?P=sep)\d{4}"  # 617 - 555 - 0130
    r"|[2-9]\d{2}[2-9]\d{6}"  # 6175550116
    r"|0\d{1,4}(?:[\s/-]{1,3}\d{2,6}){1,4}|0\d{9,10}"  # trunk zero
    r")(?![\w%]|[.,]\d|-\d)"
)
# Words before numbers that are no phone numbers.
_NO_PHONE = re.compile(r"(?:\b(?:lot|lots|order|cusip|isin|accession|series|item|page|bond|form|file|filing|case|ref|reference|invoice|account|acct|id|serial|no|number|cik|range|was|volume|shares|of)\b[.:#\s]*|[$€£])$", re.I)
_NO_PHONE_AFTER = re.compile(r"\s*(?:shares|units|lots|percent|million|billion|dollars|euros|of \d)", re.I)

_STREET = r"(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|place|pl|terrace|way|close|mews|crescent|gardens|grove|square|sq|parkway|pkwy|highway|hwy|circle|cir|row|walk|hill|quay)"
_NAMEWORD = r"[^\W\d_][^\W\d_'-]*(?:['-][^\W\d_]+)*"
_ADDRESS = [
    re.compile(rf"(?<![\w$.,/#+-])\d{{1,5}}[a-z]?(?:-\d{{1,5}})? (?:(?:north|south|east|west|[nsew]\.?) )?{_NAMEWORD}(?: {_NAMEWORD}){{0,2}}? {_STREET}\b\.?(?=\s*(?:[,;:!?)/.\n]|$)| (?:and|apt|unit|suite|ste|#|in|is|was|before|after)\b)(?:,? (?:apt|unit|suite|ste|flat)\.? ?\w{{1,4}})?", re.I),
    re.compile(r"\b(?:p\.? ?o\.? ?box|post office box|postfach|apartado(?: de correos)?|bo[iî]te postale|casella postale) ?(?:no\.? ?|#)?\d{1,6}", re.I),
    re.compile(r"\b[A-ZÄÖÜ][^\W\d_-]*(?:-[^\W\d_]+)*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm|STRASSE|GASSE|WEG|PLATZ|ALLEE) \d{1,4}[a-z]?\b|\b[a-zäöü]{3,}(?:straße|strasse|gasse|weg|platz|allee) \d{1,4}[a-z]?(?=,? \d{5}\b)"),
    re.compile(rf"\b(?:\d{{1,4}}(?: ?(?:bis|ter))?,? )?(?:rue|avenue|boulevard|place|chemin|all[ée]e|quai|impasse|calle|avenida|avda\.?|plaza|paseo|camino|carrera|via|viale|piazza)(?: (?:de|del|di|du|des|la|las|los|le|les|el))* {_NAMEWORD}(?: {_NAMEWORD})?,? (?:n[º°o]\.? ?)?\d{{1,4}}\b(?![.%]\d)", re.I),
    re.compile(rf"(?<![\w$.,/#+-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|chemin|quai|impasse)(?: (?:de|du|des|la|le|les))* {_NAMEWORD}", re.I),
]
#: At least seven digits with little between them: without it no phone pattern matches.
_DIGIT_RUN = re.compile(r"\d(?:[\s().\-/]{0,3}\d){6}")
# Words of sentences, and streets that stand for markets.
_NO_NAME = frozenset("a about after all an and any are around as at be before big but by each every first for free from good had has in is it last long market more most my new next no not of old on one or other our over own per percent same second shares so that the their then this to under was we were what will with year years your".split())
# Streets that may have a letter for a name.
_LETTERED = frozenset("street st avenue ave road rd".split())
_NO_STREET = re.compile(r"\b(?:wall|main|high|fleet|lombard) (?:street|st)\b", re.I)

# Common given names (a sample of public name statistics; a parameter of the operator).
GIVEN_NAMES = """
aaron adam ahmed aisha alan albert alejandro alexander alice amara amina amy ana andrea andrew angela anita anna anselm antonio arthur astrid
barbara beatrix benjamin bernard bram brian callum camille carlos carmen caroline catherine charles charlotte chloe christopher claire clara claudia colin
daniel david deborah devin diana diego dmitri dorothy edward elena eleanor elizabeth elodie emily emma eric erik esther ethan eva fatima felix fenna fiona
francesca frederick gabriel george gerald giulia greta hamza hannah harold helen helga henry hugo ian ibrahim ignacio ilse ines inés ingrid irene isabel
ivan jacob james jane jasper javier jean jennifer jessica joan joanna john jonas jonathan jorge joseph juan julia karen katherine kenneth kevin kwame
lars laura lena leon lindsay linnea louise lucas lucia luis magnus mara margaret maria marie martin matthew mei michael miguel miriam mohammed nadia
nancy natalie nicholas nicole nikolai nina noor odette olga oliver olivia omar oscar patricia patrick paul pedro peter philip pierre piers priya rachel
rafael rebecca richard robert rosa rosalind ruth samuel saoirse sara sarah simon sofia soren stefan stephen susan sven thomas tomas ursula victoria
wendell william yasmin yusuf zoe zoë
""".split()


def read_names(path: str, most: int = 200_000) -> tuple[str, ...]:
    """Given names of a public list: the first field of each line (``Mary,F,7065``), for ``given_names``. Read by
    the driver and sent to the tasks, so a list of more than ``most`` names is refused."""
    with open(path, encoding="utf-8") as f:
        names = dict.fromkeys(w for line in f if (w := re.split(r"[,;\t]", line.strip())[0].strip().lower()))
    if len(names) > most:
        raise ValueError(f"more than {most} names")
    return tuple(names)


# Words of company names.
_COMPANY = frozenset(
    """bancorp bank banks brands bros brothers capital co company corp corporation daughters energy equity estates family farms financial foods fund funds group holdings
    hotels inc industries insurance international investments lines llc llp logistics ltd management materials media mills mines motors outdoor partners pharma plc
    properties quarries railway resources retail semiconductor services software sons springs steel stores systems technologies textiles therapeutics trading trust ventures
    water works ag gmbh sa se nv spa mine merger street road university""".split()
)
# Capitalised words that follow a person and are no part of the name, or look like surnames and are none.
_NO_SURNAME = frozenset(
    """a about again also am an and any anyway are as ask at be bear been bought bull but by can could did do does edit evidently for from fwiw granted had has have he her his
    honestly how i if in inc is it its looking market may meanwhile my no not of oddly on or others our owes past personally please put read regards said says see send she
    so sold source sum thanks that the their then they this to told uncle was we were what when which who why will with would yes you your and""".split()
)


_SUR = r"(?:(?:de|van|von|der|del|la) )*(?:[^\W\d_]['-])?[^\W\d_]{2,}(?:['-][^\W\d_]+)*"
_INITIAL = r"(?:[^\W\d_]\.(?:[ -]?[^\W\d_]\.)?)"
_GIVEN_ANY = r"[^\W\d_]{2,}(?:-[^\W\d_]+)?"
_FORMS = rf"(?:(?P<g>{_GIVEN_ANY})(?: {_INITIAL})? (?P<s>{_SUR})|(?P<i>{_INITIAL}) (?P<s2>{_SUR})|(?P<s3>{_SUR}), (?:(?P<g3>{_GIVEN_ANY})(?: {_INITIAL})?|(?P<i3>{_INITIAL})(?!\w)))"
_AT_NAME = re.compile(_FORMS)
# Strong cues: words that announce a person.
_NAME_CUE = re.compile(
    r"(?:\b(?:mr|mrs|ms|miss|mx|dr|prof|herr|frau|monsieur|madame|señor|señora)\b\.?|\bmy name is|\b(?:name|contact|attn|attention|signature|letter|tenant|client|customer|patient|beneficiary|recipient|sender|witness):"
    r"|\b(?:best|warm|kind)? ?regards,|\bsincerely,|\bcheers,|\bthanks,\n|\bsigned,?|\bcc:?|\battn:?|\bc/o"
    r"|\b(?:spoke|spoken|talked|speak|talk|wrote|write) (?:to|with)|\bmy (?:advisor|adviser|broker|lawyer|accountant|doctor|boss|landlord|neighbour|neighbor|colleague|dentist|solicitor|attorney|agent)|\bask for|\bread out|\bdear)\s+",
    re.I,
)
# Weak cues before and behind a name: what persons do, and where they work.
_WEAK_BEFORE = re.compile(r"\b(?:phoned|rang|emailed|texted|messaged|met|meet|visited|thanked|hired|interviewed|introduced|my (?:friend|cousin|uncle|aunt|brother|sister|wife|husband|son|daughter|mate|buddy|roommate|coworker|teacher|tutor|manager))\s+", re.I)
_WORKPLACE = r"(?:from|in|at) (?:the )?(?:accounts|accounting|sales|legal|compliance|hr|support|billing|payroll|back office|front desk|branch|office|bank|shop|clinic|school|firm|agency|warehouse)"
_WEAK_VERB = r"(?:rang|phoned|called|emailed|texted|wrote|told|said|says|asked|replied|answered|signed|owes|owed|lent|promised|mentioned|explained|insisted|warned|lives|lived|works|worked|retired|died|moved|lost (?:his|her))"
_NAME_AFTER = re.compile(rf"\s+(?:{_WORKPLACE}|owes|told me|signed|and i own)\b|\s*(?:\(|/|,|\n|-|:)\s*$", re.I)
_NAME_POST = re.compile(rf" (?:{_WORKPLACE}|owes me|told me|signed it)\b", re.I)
_WEAK_POST = re.compile(rf" {_WEAK_VERB}\b")
# Words of markets behind a name: it is a company's.
_MARKET_AFTER = re.compile(
    r"(?:'s)? (?:rose|fell|gained|dropped|slid|rallied|beat|missed|trades|traded|trading|guided|yields?|shares?|stock|earnings|dividends?|bonds?|common|preferred|guidance"
    r"|is (?:up|down|trading|cheap|expensive|undervalued|overvalued)|closed (?:up|down|at)|(?:reported|posted) (?:earnings|results|revenue|a (?:loss|profit)))\b"
)
# Endings of surnames in some languages, each behind at least two letters.
_SURNAME_ENDS = "sson qvist quist stedt gaard dakis akis opoulos idis nathan swamy murthy ović ovic ovich evich wicz owski ewski inski enko chuk escu eanu shvili adze oğlu oglu nen hashi naka moto".split()
_SURNAME_SHAPE = re.compile(rf"[^\W\d_]{{2,}}(?:{'|'.join(_SURNAME_ENDS)})$", re.I)
# Sayings that look like persons.
_SAYING = re.compile(r"\b(?:uncle sam|(?:mr|dr)\.? (?:market|copper)|(?:john|jane|joe) (?:doe|public|sixpack|bloggs)|average joe)\b", re.I)
_NAME_END = re.compile(rf"(?:^|(?<=[\s(]))(?P<i>{_INITIAL}) (?P<s2>{_SUR})$")


def _name_ok(m: re.Match, given: frozenset[str], cued: bool, text: str, weak: bool = False) -> tuple[int, int] | None:
    """The span of a name, where its words and what follows allow one. ``cued``: a strong cue; ``weak``: a weak one."""
    sur = m["s"] or m["s2"] or m["s3"]
    first = m["g"] or m["g3"]
    last = sur.split(" ")[-1].lower()
    if last in _NO_SURNAME or last in _COMPANY or (first and first.lower() in _NO_SURNAME) or (first or "x").lower() in _COMPANY:
        return None
    known = first is not None and (first.lower() in given or (_SURNAME_SHAPE.match(last) is not None and first[0].isupper()))
    if not cued and not known and not (weak and first is None):
        return None
    if _SAYING.search(text, max(0, m.start() - 6), m.end()):
        return None
    if not cued and _MARKET_AFTER.match(text, m.end()):
        return None
    # letters of one manner: Title Case, CAPITALS or, beside a cue, lower case
    letters = [w for w in (first, sur) if w]
    title = all(w[0].isupper() or w.split(" ")[-1][0].isupper() for w in letters)
    if not title and not (cued and (known or first is None) and all(w.islower() for w in letters)):
        return None
    if not known and any(w.isupper() and len(w) > 1 for w in letters) and not all(w.isupper() for w in letters):
        return None
    after = re.match(r"(?: (&|[^\W\d_][\w'-]*))?(?: ([^\W\d_][\w'-]*))?", text[m.end() : m.end() + 40])
    nxt, nxt2 = (after[1] or ""), (after[2] or "")
    if nxt == "&" or nxt.lower() in _COMPANY and nxt[0].isupper() or nxt == "plc":
        return None
    if not cued and nxt[:1].isupper() and nxt2.lower() in _COMPANY and nxt2[:1].isupper() and nxt.lower() not in _NO_SURNAME and len(nxt) > 1 and not nxt.isupper():
        return None
    return m.start(), m.end()


# Words without which the address, identity and cue patterns cannot match.
_KEYS = {
    "s": "street st avenue ave road rd boulevard blvd lane ln drive dr court ct place pl terrace way close mews crescent gardens grove square sq parkway pkwy highway hwy circle cir row walk hill quay".split(),
    "b": "box,postfach,apartado,postale".split(","),
    "e": "straße strasse str. gasse weg platz allee ring ufer damm".split(),
    "r": "rue avenue boulevard place chemin allée allee quai impasse calle avenida avda plaza paseo camino carrera via viale piazza".split(),
    "i": "social ssn soc national ni nino insurance passport passeport pasaporte reisepass reisepassnummer tax taxpayer tin itin steuer-id steuerid steuer-identifikationsnummer steueridentifikationsnummer steuernummer dni nie nif identity id personalausweis personalausweisnummer".split(),
    "f": _SURNAME_ENDS,
    "w": "phoned,rang,emailed,texted,messaged,met,meet,visited,thanked,hired,interviewed,introduced,my friend,my cousin,my uncle,my aunt,my brother,my sister,my wife,my husband,my son,my daughter,my mate,my buddy,my roommate,my coworker,my teacher,my tutor,my manager".split(","),
    "v": "rang,phoned,called,emailed,texted,wrote,told,said,says,asked,replied,answered,signed,owes,owed,lent,promised,mentioned,explained,insisted,warned,lives,lived,works,worked,retired,died,moved,lost his,lost her".split(","),
    "c": "name:,attention:,signature:,letter:,tenant:,client:,customer:,patient:,beneficiary:,recipient:,sender:,witness:,my colleague,my dentist,my solicitor,my attorney,my agent,mr,mrs,ms,miss,mx,dr,prof,herr,frau,monsieur,madame,señor,señora,my name is,regards,sincerely,cheers,thanks,signed,contact:,cc,attn,c/o,spoke to,spoke with,spoken to,spoken with,talked to,talked with,speak to,speak with,talk to,talk with,wrote to,write to,my advisor,my adviser,my broker,my lawyer,my accountant,my doctor,my boss,my landlord,my neighbour,my neighbor,ask for,read out,lost letter,dear".split(","),
    "p": "accounts,accounting,sales,legal,compliance,hr,support,billing,payroll,back office,front desk,branch,office,bank,shop,clinic,school,firm,agency,warehouse,owes me,told me,signed it".split(","),
}


def _no_street_name(found: str) -> bool:
    """"1099 to my old place", "12 after market close": words of a sentence between number and street.
    A name in lower case has one word. A letter is a name too ("1600 K Street"), but a small one, or one before a
    word in small letters, only of a street or road ("up 5 k way"), and a small "a" never."""
    words = re.findall(r"[^\W\d_][\w'-]*", found.split(",")[0].split(" ", 1)[1])  # behind the number: 15b
    words = words[1:] if len(words) > 2 and len(words[0]) == 1 else words  # N Main Street
    name = words[:-1]
    if len(name[0]) == len(name) == 1:
        return name[0] == "a" or not (words[-1].lower() in _LETTERED or (name[0].isupper() and words[-1].istitle()))
    return any(w.lower() in _NO_NAME for w in name) or (name[0].islower() and (len(name) > 1 or not words[-1].islower()))


def _overlaps(a: int, z: int, taken: list[tuple[int, int]]) -> bool:
    return any(a < y and x < z for x, y in taken)


class Finder:
    """Detects items in one text. ``given_names``: lower-case given names that mark a person without a cue.

    One pass of an automaton over the words of all patterns says which patterns can match at all."""

    def __init__(self, given_names: Iterable[str] = GIVEN_NAMES) -> None:
        import ahocorasick

        self.given = frozenset(given_names)
        kinds: dict[str, str] = {}
        for kind, words in (*_KEYS.items(), ("g", self.given)):
            for w in words:
                kinds[w] = kinds.get(w, "") + kind
        self.words = ahocorasick.Automaton()
        for w, k in kinds.items():
            self.words.add_word(w, (k, len(w)))
        self.words.make_automaton()

    def _hits(self, t: str) -> tuple[set[str], list[tuple[int, int, bool]]]:
        low = t.lower()
        if len(low) != len(t):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in t)
        kinds, given, n = set(), [], len(t)
        for end, (k, size) in self.words.iter(low):
            a, z = end - size + 1, end + 1
            if z < n and low[z].isalnum():
                continue
            if "f" in k:  # the end of a surname
                given.append((a, z, True))
            if "e" in k and low[z : z + 1] == " " and low[z + 1 : z + 2].isdigit():  # the end of a street's name and its number
                kinds.add("e")
            k = k.replace("e", "").replace("f", "")
            if not k:
                continue
            if a and low[a - 1].isalnum():
                continue
            kinds.update(k)
            if "g" in k:
                given.append((a, z, False))
        return kinds, given

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """``(type, start, end)`` in source code points, in order of place."""
        m = normalise(text)
        t, out, taken = m.text, [], []
        kinds, given = self._hits(t)

        def take(kind: str, a: int, z: int) -> bool:
            if _overlaps(a, z, taken):
                return False
            taken.append((a, z))
            out.append((kind, a, z))
            return True

        if "@" in t:
            for x in _EMAIL.finditer(t):
                take("email", x.start() + len(x[0]) - len(x[0].lstrip("_.+%'-")), x.end())
        numbers = _DIGIT_RUN.search(t) is not None
        if "i" in kinds:
            for x in _ID_LABEL.finditer(t):
                if (v := _ID_VALUE.match(t, x.end())) and sum(c.isdigit() for c in v[0]) >= 6:
                    take("id_number", v.start(), v.end())
        if numbers or "QQ" in t or _SIX.search(t):
            for x in _ID_SHAPE.finditer(t):
                take("id_number", x.start(), x.end())
        if numbers:
            for x in _PHONE.finditer(t):
                a = x.start() + (len(x[0]) - len(x[0].lstrip(" .-")))
                n = sum(c.isdigit() for c in x[0])
                if 7 <= n <= 15 and not _NO_PHONE.search(t[max(0, a - 24) : a]) and not _NO_PHONE_AFTER.match(t, x.end()):
                    take("phone", a, x.end())
        if not kinds.isdisjoint("sber") and _ANY_DIGIT.search(t):
            for p in [p for k, p in zip("sberr", _ADDRESS, strict=True) if k in kinds]:
                for x in p.finditer(t):
                    if not (_NO_STREET.search(x[0]) and not re.match(r"\s*,", t[x.end() : x.end() + 2])) and not (p is _ADDRESS[0] and _no_street_name(x[0])):
                        take("address", x.start(), x.end())
        if out or given or not kinds.isdisjoint("cpwv"):
            self._names(t, list(taken), kinds, given, take)
        if m.pos is not None:
            out = [(k, *m.source(a, z)) for k, a, z in out]
        return sorted(out, key=lambda r: r[1])

    def _names(self, t: str, items: list[tuple[int, int]], kinds: set[str], given: list[tuple[int, int, bool]], take) -> None:
        if "c" in kinds:
            for x in _NAME_CUE.finditer(t):
                at = x.end()
                while nxt := _NAME_CUE.match(t, at):  # "Ask for Ms."
                    at = nxt.end()
                if (m := _AT_NAME.match(t, at)) and (r := _name_ok(m, self.given, True, t)):
                    take("name", *r)
        for a, _ in items:  # a name right before another item: "NAME (mail, phone)", "NAME, 12 Linden Road"
            base = max(0, a - 60)
            if before := _BEFORE_ITEM.search(t[base:a]):
                words, base = before["all"], base + before.start("all")
                for w in re.finditer(r"(?<!\S)\S", words):
                    m = _AT_NAME.match(t, base + w.start())
                    if m and m.end() == base + len(words) and (r := _name_ok(m, self.given, True, t[: m.end()])) and take("name", *r):
                        break
        if "p" in kinds:
            for x in _NAME_POST.finditer(t):  # "D. Ostervane from accounts signed it"
                base = max(0, x.start() - 50)
                if (m := _NAME_END.search(t[base : x.start()])) and (r := _name_ok(_AT_NAME.match(t, m.start() + base), self.given, True, t)):
                    take("name", *r)
        if "w" in kinds:
            for x in _WEAK_BEFORE.finditer(t):
                if (m := _AT_NAME.match(t, x.end())) and (r := _name_ok(m, self.given, False, t, True)):
                    take("name", *r)
        if "v" in kinds:
            for x in _WEAK_POST.finditer(t):  # "Q. Ostervane phoned"
                base = max(0, x.start() - 50)
                if (m := _NAME_END.search(t[base : x.start()])) and (r := _name_ok(_AT_NAME.match(t, m.start() + base), self.given, False, t, True)):
                    take("name", *r)
        for a, z, ending in given:
            if a and t[a - 1] in "@./+-" or t[z : z + 1] in ("@", "'", "_"):
                continue
            if ending:  # the given name is the word before
                base = max(0, a - 60)
                if x := _BEFORE_ENDING.search(t[base:z]):
                    a = base + x.start()
                    z = base + x.end(1)
                else:
                    continue
            base = max(0, a - 40)
            if (rev := _BEFORE_COMMA.search(t[base:a])) and (r := _reverse_ok(rev[1], base + rev.start(1), a, z, t)) and not ending:
                take("name", *r)
            m = _AT_NAME.match(t, a)
            if m and m["g"] and m.end("g") == z:
                cued = bool(_NAME_AFTER.match(t[m.end() : m.end() + 24]))
                if r := _name_ok(m, self.given, cued and not ending, t):
                    take("name", *r)


_ANY_DIGIT, _SIX = re.compile(r"\d"), re.compile(r"\d\d ?\d\d ?\d\d")
_BEFORE_ITEM = re.compile(r"(?P<all>(?:[^\W\d_][\w'.-]*,? ){1,3}[^\W\d_][\w'.-]*)(?: [(/]|,|\n| \() ?$")
_BEFORE_COMMA = re.compile(rf"(?<![\w@./+'-])({_SUR}), $")
_BEFORE_ENDING = re.compile(rf"(?<![\w@./+'-])({_GIVEN_ANY})(?: {_INITIAL})? [^\W\d_]+$")
_INITIAL_NEXT = re.compile(rf" {_INITIAL}(?!\w)")


def _reverse_ok(sur: str, start: int, a: int, z: int, t: str) -> tuple[int, int] | None:
    """"Surname, Given" without a word before it; a list of names or a sentence's comma is none."""
    if not sur[0].isupper() or not t[a].isupper() or sur.lower() in _NO_SURNAME or sur.lower() in _COMPANY:
        return None
    if more := _INITIAL_NEXT.match(t, z):
        z = more.end()
    cued = bool(_NAME_AFTER.match(t[z : z + 24]))
    follows = re.match(r" ([^\W\d_][\w'-]*)", t[z : z + 30])
    if follows and follows[1][0].isupper() and follows[1].lower() not in _NO_SURNAME and not cued:
        return None  # "Ohio, Martin Brackwell": the given name belongs to what follows
    if re.search(r"[A-Z][\w'-]+,? $", t[max(0, start - 16) : start]) and not cued:
        return None
    return start, z


_PLACEHOLDER = {k: f"[{k.upper()}]" for k in TYPES}


def redact(text: str, items: Iterable[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, z in items:
        if a >= at:
            out += (text[at:a], _PLACEHOLDER[kind])
            at = z
    return "".join([*out, text[at:]])


def find_items(df: DataFrame, text_col: str, row_col: str, src: str, given_names: tuple[str, ...] = tuple(GIVEN_NAMES)) -> DataFrame:
    """``src, ingest_no, pii_type, span_start, span_end``: one row per item of every row.

    Null and empty texts have no items; texts of any length are read whole; repeated rows give
    repeated items; bytes that are no UTF-8 count as replacement characters. A map over the rows.
    Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(given_names)
        for b in batches:
            rows = [(src, n, k, a, z) for n, t in zip(b["row_no"], b["text"], strict=True) for k, a, z in finder.find(t)]
            yield pd.DataFrame(rows, columns=["src", "ingest_no", "pii_type", "span_start", "span_end"])

    return spread(df.where(F.col(text_col).isNotNull()).select(F.col(row_col).cast("long").alias("row_no"), F.make_valid_utf8(text_col).alias("text"))).mapInPandas(run, FOUND)


def redacted(df: DataFrame, text_col: str, given_names: tuple[str, ...] = tuple(GIVEN_NAMES)) -> DataFrame:
    """``df`` with ``text_col`` redacted; null stays null, all other columns stay. Bytes that are no UTF-8
    become replacement characters."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(given_names)
        for texts in batches:
            yield pd.Series([None if t is None else redact(t, finder.find(t)) for t in texts], dtype=object)

    return df.withColumn(text_col, clean(F.make_valid_utf8(text_col)))
