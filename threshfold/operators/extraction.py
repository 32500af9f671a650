"""Entity mentions in free text: cashtags, company names and bare symbols, with evidence.

Token and n-gram lookup only: a document costs its tokens times the longest name, whatever the size
of the dictionaries. Cues are located once per document as sorted places, and a mention asks by
binary search whether one lies in its window. The dictionaries are broadcast after their size is
checked; larger ones go through :func:`ngram_matches`, which joins exploded n-grams.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshfold.functions.text import HYGIENE
from threshfold.session import spread

#: Most words of a name.
LONGEST_NAME = 4
#: Most entries that are sent to the tasks.
MAX_DICTIONARY = 500_000
COMMON_RANK = 20_000
RADIUS = 220

# Jargon that is never accepted bare.
JARGON = tuple(
    """DD EPS ROIC ROE ROA PE PEG EV FCF DCF WACC CAGR TAM SAM COGS SGA EBIT EBITDA NAV BV PB PS YOY QOQ TTM LTM GAAP CAPEX OPEX ARR MRR KPI IPO SPAC ETF REIT LBO MOAT MOS
    CEO CFO COO CTO IR SEC FED IRS FTC DOJ ATH ATL YOLO FOMO HODL TA FA PT SL TP OTC NYSE AH PM EOD EOY GDP CPI PPI PMI QE QT
    USD EUR GBP JPY CNY RMB CHF SEK NOK DKK AUD CAD NZD HKD SGD INR KRW TWD THB IDR MYR RM PHP VND BRL MXN ARS CLP COP PEN ZAR NGN EGP RUB TRY PLN CZK HUF RON ILS AED SAR QAR KWD BHD
    PKR BDT LKR NPR KES IMO IMHO TLDR TL DR AFAIK IIRC OP EDIT NSFW LOL IDK AKA FYI BTW ELI ETA PSA US USA UK EU AI ML""".split()
)
# Prose markers, fund brands and vendors.
PROSE_MARKERS = frozenset("PS PPS NB FYI EDIT TLDR TL IMO IMHO BTW AKA ETA PSA UPDATE NOTE SOURCE RE".split())
FUND_BRANDS = frozenset({"ishares", "vanguard", "spdr", "invesco", "wisdomtree", "proshares", "direxion", "globalx", "global x", "vaneck", "first trust", "schwab etf"})
VENDORS = frozenset("MORN FDS MSCI SPGI MCO NDAQ ICE TRI LSEGY CBOE".split())
# Cue words, in lower case; a slash may be left out.
VALUATION_WORDS = (
    "p/e,p/b,p/s,ev/ebitd,ev/ebitda,dcf,fcf,roic,roe,margin,moat,earnings,revenue,dividend,yield,buyback,book value,intrinsic,undervalued,overvalued,valuation,market cap,mkt cap,share,shares,stock,position,"
    "bought,buying,sold,selling,holding,long,short,price target,balance sheet,cash flow,eps,guidance,multiple,cheap,expensive,value trap,bagger,ticker"
)
FRAMING_WORDS = "long,short,own,owning,bought,buying,sell,selling,sold,position,share,shares,stock,valuation,undervalued,overvalued,moat,p/e,market cap,revenue,earnings,margin,dividend,buyback,holding,portfolio"
# What cites a source, before and behind a name, and what names a venue.
CITING_BEFORE_WORDS = "according to,as per,source from,sourced from,data from,screenshot from,pulled from,via,courtesy of"
CITING_AFTER_WORDS = "say,says,said,show,shows,showed,report that,reports that,rate it,rates it,estimate,estimates,screener,terminal,fair value estimate,premium,paywall,.com,.co.uk"
VENUE_VERBS, VENUE_AT = "listed,trade,trades,trading,traded,quoted,delisted,ipod,ipo'd,available", "on,at,via"
# Numbers that tell of money, and signs that make capitals a symbol.
MONEY = re.compile(r"\$\s?\d|\d+\s?[x%]|\b\d+\.\d+\b")
SYMBOL_SYNTAX = re.compile(r"[(\[][A-Z]{1,5}[)\]]|\b[A-Z]{2,5}\s*[:\-–]\s")


def any_of(words: str) -> str:
    """A pattern of any of the words; longer ones first, as the first to match ends the search."""
    return "(?:" + "|".join(re.escape(w).replace("/", "/?").replace("\\ ", " ") for w in sorted(words.split(","), key=len, reverse=True)) + ")"


VALUATION, FRAMING = (re.compile(rf"\b{any_of(w)}\b", re.I) for w in (VALUATION_WORDS, FRAMING_WORDS))
CITING_BEFORE = re.compile(rf"\b{any_of(CITING_BEFORE_WORDS)}\s*$", re.I)
CITING_AFTER = re.compile(rf"\s*{any_of(CITING_AFTER_WORDS)}\b", re.I)
VENUE_BEFORE = re.compile(rf"{any_of(VENUE_VERBS)}\s+{any_of(VENUE_AT)}\s+(?:the\s+)?$", re.I)
_CLEANERS = [(re.compile(p.replace("(?md)", "(?m)")), r.replace("$1", r"\1")) for p, r in HYGIENE]
_WORD, _SYMBOL = re.compile(r"[A-Za-z0-9&]+"), re.compile(r"(\$?)\b([A-Z]{1,5})(?:\.([A-Z]))?\b")
_GAP = re.compile(r"[ \t]*[,/][ \t\n]*|[ \t]*\n[ \t]*|[ \t]+")  # what may stand between the symbols of a list


def clean(text: str | None) -> str:
    for p, r in _CLEANERS:
        text = p.sub(r, text or "")
    return text or ""


class Places:
    """Sorted places of a cue; asks whether one lies within a window."""

    def __init__(self, pattern: re.Pattern, text: str) -> None:
        self.at = [m.span() for m in pattern.finditer(text)]

    def within(self, a: int, z: int) -> bool:
        i = bisect_left(self.at, (a, -1))
        return i < len(self.at) and self.at[i][1] <= z


def _plain(name: str) -> bool:
    """Whether a name is words of letters and digits, set apart by blanks and ampersands."""
    words = re.findall(r"[^ &]+", name)
    return bool(words) and all(map(str.isalnum, words))


class Lexicon:
    """``symbols``: symbol to entity; ``names``: normalised name to entity; ``manual``: names that
    need no proof by length; ``ranks``: rank of common words.

    Three indexes are made of them: by entity its first symbol, by first word the longest name that
    starts with it, and by either half the single-word names that may be meant with one letter wrong
    (a wrong letter leaves one half of a name as it is)."""

    def __init__(self, symbols: dict[str, str], names: dict[str, str], manual: frozenset[str] = frozenset(), ranks: dict[str, int] | None = None) -> None:
        self.symbols, self.manual, self.ranks = symbols, manual, ranks or {}
        self.names = {n: e for n, e in names.items() if n in manual or len(n) >= 5 and _plain(n)}
        self.symbol_of = {e: s for s, e in reversed(symbols.items())}
        words = [n.split(" ") for n in self.names]
        self.heads = {w[0]: len(w) for w in sorted(words, key=len) if len(w) <= LONGEST_NAME}
        self.halves: dict[tuple[bool, str], list[str]] = defaultdict(list)
        for n in (w[0] for w in words if len(w) == 1 and len(w[0]) >= 7 and w[0].isalpha()):
            self.halves[True, n[: len(n) // 2]].append(n)
            self.halves[False, n[len(n) // 2 :]].append(n)
        self._met: dict[str, str | None] = {}

    def common(self, word: str) -> bool:
        return self.ranks.get(word, COMMON_RANK + 1) <= COMMON_RANK

    def tier(self, symbol: str) -> str:
        return "JARGON" if len(symbol) == 1 or symbol in JARGON else "COMMON" if self.common(symbol.lower()) else "CLEAR"

    def entity(self, base: str, share_class: str | None) -> str | None:
        return (self.symbols.get(f"{base}-{share_class}") if share_class else None) or self.symbols.get(base)

    def name_at(self, low: list[str], i: int) -> int:
        """How many words the longest name that starts at a place has; 0 for none."""
        most = min(self.heads.get(low[i], 0), len(low) - i)
        return next((k for k in range(most, 0, -1) if " ".join(low[i : i + k]) in self.names), 0)

    def close_to(self, word: str) -> str | None:
        """The name within one edit that starts alike: the shortest, then the first by letters."""
        if word not in self._met:
            if len(self._met) >= MAX_DICTIONARY:
                self._met.clear()
            sizes = {(n // 2, n - n // 2) for n in (len(word) - 1, len(word), len(word) + 1)}
            near = {n for a, z in sizes for n in (*self.halves.get((True, word[:a]), ()), *self.halves.get((False, word[-z:]), ())) if n[:2] == word[:2] and one_edit(word, n)}
            self._met[word] = min(near, key=lambda n: (len(n), n), default=None)
        return self._met[word]


def one_edit(a: str, b: str) -> bool:
    """Whether at most one letter is added, lost or changed."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :] or a == b


class Extractor:
    def __init__(self, lex: Lexicon) -> None:
        self.lex = lex

    def mentions(self, text: str) -> list[dict]:
        """Mentions in order of place: entity, symbol, channel, confidence, span, evidence."""
        t = clean(text)
        if not t:
            return []
        self.text = t
        self._cues: dict[str, Places] = {}
        symbols = [(m, m[2], m[2] + (f"-{m[3]}" if m[3] else ""), self.lex.entity(m[2], m[3])) for m in _SYMBOL.finditer(t)]
        hits = [self._hit(e, sym, "cashtag", 0.97, m.start(), m.end(), ["cashtag"]) for m, _, sym, e in symbols if m[1] and e]
        names = list(self._names())
        tagged, named = {b for m, b, _, _ in symbols if m[1]}, {h["entity_id"] for h in names}
        lists = self._lists(symbols)
        hits += names
        for m, base, sym, e in symbols:
            if not m[1] and e and (h := self._bare(m, base, sym, e, base in tagged, e in named, lists)):
                hits.append(h)
        return merge_spans(hits)

    def cue(self, name: str) -> Places:
        """The places of a cue in the text at hand, looked for when they are first asked for."""
        if name not in self._cues:
            self._cues[name] = Places({"valuation": VALUATION, "money": MONEY, "framing": FRAMING}[name], self.text)
        return self._cues[name]

    @staticmethod
    def _hit(entity: str, symbol: str, channel: str, conf: float, a: int, z: int, evidence: list[str]) -> dict:
        return {"entity_id": entity, "ticker": symbol, "channel": channel, "confidence": conf, "start": a, "end": z, "evidence": evidence}

    def _cited(self, a: int, z: int) -> bool:
        return bool(CITING_BEFORE.search(self.text[max(0, a - 40) : a]) or CITING_AFTER.match(self.text[z : z + 40]))

    def _valued(self, a: int, z: int) -> bool:
        return self.cue("valuation").within(max(0, a - RADIUS), z + RADIUS)

    def _names(self) -> Iterator[dict]:
        lex, t = self.lex, self.text
        words = list(_WORD.finditer(t))
        low = [w[0].lower() for w in words]
        i = 0
        while i < len(words):
            k = lex.name_at(low, i) if low[i] in lex.heads else 0
            if not k:
                w = words[i][0]
                if len(w) >= 7 and w[0].isupper() and w.isalpha() and not lex.common(low[i]) and (n := lex.close_to(low[i])) and self._valued(*words[i].span()):
                    a, z = words[i].span()
                    e = lex.names[n]
                    yield self._hit(e, lex.symbol_of.get(e, ""), "name", 0.78, a, z, ["company_name", "fuzzy"])
                i += 1
                continue
            a, z = words[i].start(), words[i + k - 1].end()
            name = " ".join(low[i : i + k])
            i += k
            e = lex.names[name]
            sym = lex.symbol_of.get(e, "")
            if t[a:z].lower() in FUND_BRANDS:
                continue
            conf, evidence = 0.90, ["company_name"]
            if sym in VENDORS and (VENUE_BEFORE.search(t[max(0, a - 40) : a]) or not self.cue("framing").within(max(0, a - 60), z + 60)):
                conf, evidence = 0.50, [*evidence, "vendor_citation"]
            elif self._cited(a, z):
                conf, evidence = 0.55, [*evidence, "citation_context"]
            elif k == 1 and name not in lex.manual and lex.common(name):
                if not t[a].isupper() or not self._valued(a, z):
                    continue
                conf, evidence = 0.75, [*evidence, "capitalised+valuation"]
            yield self._hit(e, sym, "name", conf, a, z, evidence)

    def _lists(self, symbols: list) -> list[tuple[int, int]]:
        """Runs of at least three symbols with nothing but separators between, at least three and
        60 % of them known, at most 70 % of them ordinary words."""
        runs: list[list] = []
        for s in symbols:
            if s[0][3] or s[0][1]:  # a share class or a cashtag ends a run
                runs.append([])
            elif runs and runs[-1] and _GAP.fullmatch(self.text, runs[-1][-1][0].end(), s[0].start()):
                runs[-1].append(s)
            else:
                runs.append([s])
        out = []
        for r in runs:
            known = sum(1 for s in r if s[1] in self.lex.symbols)
            if len(r) >= 3 and known >= max(3, 0.6 * len(r)) and sum(1 for s in r if self.lex.tier(s[1]) != "CLEAR") <= 0.7 * len(r):
                out.append((r[0][0].start(), r[-1][0].end()))
        return out

    def _bare(self, m: re.Match, base: str, sym: str, e: str, tagged: bool, named: bool, lists: list[tuple[int, int]]) -> dict | None:
        a, z = m.span()
        i = bisect_right(lists, (a, 1 << 60)) - 1
        listed = i >= 0 and z <= lists[i][1]
        syntax = base not in PROSE_MARKERS and bool(SYMBOL_SYNTAX.search(self.text[max(0, a - 2) : z + 3]))
        near = (max(0, a - RADIUS), z + RADIUS)
        strong = [n for n, ok in (("name_in_doc", named), ("cashtag_in_doc", tagged), ("symbol_syntax", syntax), ("ticker_list", listed)) if ok]
        evidence = strong + [n for n, ok in (("valuation_language", self.cue("valuation").within(*near)), ("numeric_context", self.cue("money").within(*near))) if ok]
        hit = lambda c, *more: self._hit(e, sym, "bare", c, a, z, [*evidence, *more])
        if sym in VENDORS and not listed and not self.cue("framing").within(max(0, a - 60), z + 60):
            return hit(0.50, "vendor_citation")
        if self._cited(a, z):
            return hit(0.55, "citation_context")
        tier = self.lex.tier(base)
        if tier == "JARGON":
            lone = len(base) == 1 and evidence == ["ticker_list"]
            return None if not strong or lone else hit(0.88 if listed else 0.80)
        if tier == "COMMON":
            return hit(0.88) if strong else hit(0.72) if len(evidence) >= 2 else None
        return hit(0.93 if strong else 0.85 if evidence else 0.70)


def merge_spans(hits: list[dict]) -> list[dict]:
    """Overlapping mentions of one entity as one: the first span stays as it is, evidence is united,
    the highest confidence counts. Order: entity, start, falling confidence."""
    out: list[dict] = []
    for h in sorted(hits, key=lambda h: (h["entity_id"], h["start"], -h["confidence"])):
        if out and out[-1]["entity_id"] == h["entity_id"] and h["start"] < out[-1]["end"]:
            out[-1] |= {"evidence": sorted({*out[-1]["evidence"], *h["evidence"]}), "confidence": max(out[-1]["confidence"], h["confidence"])}
        else:
            out.append(dict(h))
    return sorted(out, key=lambda h: (h["start"], h["end"]))


MENTION = (
    "doc_type string, doc_id string, created_utc long, author string, link_id string, score int, entity_id string, ticker string, channel string, confidence double, "
    "span_start int, span_end int, evidence array<string>, in_title boolean, is_primary boolean, n_entities_in_doc int"
)
_KEEP = ["doc_type", "doc_id", "created_utc", "author", "link_id", "score"]


def lexicon(tickers: DataFrame, words: DataFrame | None = None, manual: frozenset[str] = frozenset(), symbol: str = "ticker", entity: str = "entity_id", name: str = "name") -> Lexicon:
    """Dictionaries from a ticker table, the latest known statement of a symbol or name first.

    Raises where they would exceed MAX_DICTIONARY entries."""
    from threshfold.functions.text import normalise_name

    s = tickers.where(F.col(symbol).isNotNull() & F.col(entity).isNotNull())
    latest = F.max_by(entity, F.struct("known_on", "listing_no"))
    sym = s.groupBy(F.regexp_replace(F.upper(F.trim(symbol)), r"^\$|[./](?=[A-Z]$)", "-").alias("k")).agg(latest.alias("e"))
    nam = s.where(F.col(name).isNotNull()).groupBy(normalise_name(F.col(name)).alias("k")).agg(latest.alias("e"))
    out = []
    for d in (sym, nam):
        got = d.where("k <> ''").limit(MAX_DICTIONARY + 1).collect()
        if len(got) > MAX_DICTIONARY:
            raise ValueError("too many entries to broadcast: use ngram_matches")
        out.append({r["k"].lstrip("-"): r["e"] for r in sorted(got, key=lambda r: r["k"])})
    ranks = {}
    if words is not None:  # words beyond COMMON_RANK count as uncommon whether they are listed or not
        got = words.where((F.col("rank_no") <= COMMON_RANK) & F.col("word").isNotNull()).select("word", "rank_no").limit(MAX_DICTIONARY + 1).collect()
        if len(got) > MAX_DICTIONARY:
            raise ValueError("too many ranked words to broadcast")
        ranks = {r[0]: r[1] for r in got}
    return Lexicon(*out, manual=manual, ranks=ranks)


def extract_mentions(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Mentions of documents (``doc_type, doc_id, created_utc, author, link_id, score, title, text``).

    ``text`` of a post is title, newline and body. Spans are places in the cleaned text, ``in_title``
    compares them with the cleaned title. Null and empty texts have no mentions. A map over documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ex = Extractor(lex)
        for b in batches:
            rows = []
            found = [(i, h) for i, t in enumerate(b["text"]) if (h := ex.mentions(t))]  # only documents with a mention become records
            records = b.iloc[[i for i, _ in found]].to_dict("records")
            for r, (_, hits) in zip(records, found, strict=True):
                seen = Counter(h["entity_id"] for h in hits)
                top = max(seen, key=seen.get)  # the first of equals: hits are in order of place
                title = len(clean(r["title"])) if r["doc_type"] == "post" and r["title"] else 0
                rows += [(*(r[c] for c in _KEEP), h["entity_id"], h["ticker"], h["channel"], round(h["confidence"], 3), h["start"], h["end"], h["evidence"], h["start"] < title, h["entity_id"] == top, len(seen)) for h in hits]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in MENTION.split(", ")])
            yield out.astype({"created_utc": "Int64", "score": "Int64"})

    return spread(docs.where(F.col("text").isNotNull()).select(*_KEEP, "title", "text")).mapInPandas(run, MENTION)


def with_ngrams(docs: DataFrame, text: str, longest: int, out: str = "grams") -> DataFrame:
    """``docs`` with all runs of one to ``longest`` words of a text, in lower case.

    One projection per length: each is zipped from the one before and computed once per row."""
    d = docs.withColumn("__w1", F.filter(F.split(F.lower(text), "[^a-z0-9&]+"), lambda x: x != ""))
    for n in range(2, longest + 1):
        pair = F.zip_with(f"__w{n - 1}", F.slice("__w1", F.lit(n), F.greatest(F.size("__w1"), F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
        d = d.withColumn(f"__w{n}", F.filter(pair, lambda x: x.isNotNull()))
    return d.withColumn(out, F.concat(*[f"__w{n}" for n in range(1, longest + 1)])).drop(*[f"__w{n}" for n in range(1, longest + 1)])


def ngram_matches(docs: DataFrame, names: DataFrame, doc_id: str, text: str, longest: int = 4) -> DataFrame:
    """``doc_id, name, n``: names (``name``) that occur in texts as whole words, by a join of
    exploded n-grams; overlapping names all count. For dictionaries of any size."""
    d = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    # outer: a plain explode infers a filter on its array, which repeats the n-grams below every projection
    grams = with_ngrams(d, "text", longest).select("doc_id", F.explode_outer("grams").alias("name"))
    hits = grams.join(names.select("name").distinct(), "name")  # before counting: few n-grams are names
    return hits.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


def near_matches(words: DataFrame, names: DataFrame, least: int = 7) -> DataFrame:
    """``word, name``: words within one edit of a longer single-word name that starts alike.

    Blocked by the first two letters and the length, the name's lengths exploded; words that are
    names themselves have no near match."""
    ok = lambda c: (F.length(c) >= least) & F.col(c).rlike("^[a-z]+$")
    n = names.where(ok("name")).select("name").distinct()
    n = n.select("name", F.substring("name", 1, 2).alias("p"), F.explode(F.array(F.length("name") - 1, F.length("name"), F.length("name") + 1)).alias("l"))
    w = words.where(ok("word")).select("word").distinct().join(names.select(F.col("name").alias("word")), "word", "left_anti")
    w = w.withColumns({"p": F.substring("word", 1, 2), "l": F.length("word")})
    return w.join(n, ["p", "l"]).where(F.levenshtein("word", "name", 1) >= 0).select("word", "name")
