"""Per-document text quality statistics and the form of a text.

Statistics are computed on whole batches of text: characters through one table of character classes,
words through the dictionary of a batch (each distinct word is looked at once), lines and rows with
Arrow kernels. A text is read as segments: its lines, long lines cut at blanks into pieces of at most
``PIECE`` characters.

Two sets of fixed-threshold rules are applied. ``RULES`` are published ones on whole documents; they
say whether a text is fit for use, and not whether it is a list, a table or junk. ``SEGMENT_RULES``
give a segment its form by thresholds of our own; a document has the form that holds most of its
characters. Every rule that a document fails, or that gave it its form, is recorded by name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshfold.session import spread

PIECE = 400
#: Characters handled at once, whatever the batch holds.
SLICE_CHARS = 4_000_000
FORMS = ("prose", "list", "table", "junk")

# Function words of some languages besides the ranked English words.
_FUNCTION_WORDS = """der die das und ist nicht ein eine im in zu mit für auf bei wird war aber weil obwohl wie von den dem des sich auch als es ich wir viel sehr kaum
le la les des du et est un une en pour pas que qui ce dans sur au par plus sans nous avec à il elle comme car donc malgré
el los las de y es no por con una lo se su al más pero como para sigue muy ya este esta porque así que
il lo gli di che e non per una con sono della del het een van niet op te dat voor zijn met och att det som på av är inte og er det til ikke não uma os da do em""".split()

# Published rules and thresholds (the Gopher quality filters; terminal punctuation after C4 and
# FineWeb): name, statistic, lower and upper bound.
RULES = (
    ("word_count", "n_words", 50, 100_000),
    ("mean_word_length", "mean_word_length", 3.0, 10.0),
    ("symbol_ratio", "symbol_ratio", None, 0.10),
    ("bullet_lines", "bullet_share", None, 0.90),
    ("ellipsis_lines", "ellipsis_share", None, 0.30),
    ("alphabetic_words", "alpha_share", 0.80, None),
    ("common_words", "common_share", 0.05, None),
    ("punctuated_lines", "punct_line_share", 0.12, None),
)
STATS = ("n_words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "bullet_share", "ellipsis_share", "alpha_share")
OUT = "doc_id long, n_words long, mean_word_length double, symbol_ratio double, punct_line_share double, common_share double, bullet_share double, ellipsis_share double, alpha_share double, form string, prose_share double, reasons array<string>"

#: Segment rules: name, form, and conditions (statistic, at least, at most) that all hold. Of several the first in
#: this order gives the form; a segment without a rule is prose. ``rep_words`` and ``dup_lines`` are repetition
#: after the Gopher filters, ``braces`` after C4's rule against code; the other thresholds are our own.
SEGMENT_RULES = (
    ("table_rows", "table", (("table_row", 1, None),)),
    ("bullet_entries", "list", (("bullet", 1, None), ("plain_words", None, 9), ("sentence", None, 0))),
    ("parted_entries", "list", (("parts", 5, None), ("words_a_part", 0.5, 4), ("function_share", None, 0.0999), ("bracket_share", None, 0.0499), ("page_furniture", None, 0), ("distinct_share", 0.3001, None), ("broken_share", None, 0.0999))),
    ("encoded", "junk", (("encoded_share", 0.5001, None),)),
    ("markup", "junk", (("tag_share", 0.5001, None), ("bullet", None, 0))),
    ("braces", "junk", (("code_share", 0.1201, None), ("bullet", None, 0))),
    ("damaged", "junk", (("broken_share", 0.1501, None),)),
    ("decoration", "junk", (("text_share", None, 0.3499), ("bullet", None, 0))),
    ("furniture", "junk", (("furniture_share", 0.6001, None), ("words", 6, None))),
    ("rep_words", "junk", (("words", 8, None), ("distinct_share", None, 0.3))),
    ("gibberish", "junk", (("words", 4, None), ("function_share", None, 0.0799), ("odd_share", 0.3501, None), ("words_a_part", 2.0001, None))),
    ("dup_lines", "junk", (("dup_line", 1, None), ("words", None, 11))),
    ("short_lines", "list", (("stub_line", 1, None),)),
)

_BULLET = r"^\s*(?:[-*+•·‣◦▪–—]|\(?\d{1,3}[.)])\s+\S"
_RULE_LINE = r"^\s*[+|]?[\s:|+=-]*-{2,}[\s:|+=-]*$"
_NUMBER = r"^[-+$€£(]*[\d.,]*\d[%)kKmMbB]*$"
_ENDS = r"""[.!?…]["'”’»)\]*_]*[\s\p{Z}]*$"""
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_ODD = r"[bcdfghjklmnpqrstvwxz]{5}|[aeiou]{4}|^[bcdfghjklmnpqrstvwxz]{4}|[qjx][bcdfghjklmnpqrstvwxz]|[bcdfghjklmnpqrstvwxz]{4}$"
# Words of page furniture.
_FURNITURE = "home next prev previous top share report rules about login log in sign up register cookies cookie permalink reply menu search subscribe contact privacy terms back more save hide edit faq help".split()
_DELIMS = ("|", "\t", ";", ",", "  ")

LETTER, DIGIT, BLANK, CODE, BRACKET, BROKEN, PART, DASH = (1 << i for i in range(8))


@lru_cache(1)
def classes() -> np.ndarray:
    """Flags of every code point: letter, digit, blank, and the signs that some rules count."""
    got = np.zeros(0x110000, np.uint8)
    kind = np.array([unicodedata.category(chr(c)) for c in range(0x110000)])
    got[np.char.startswith(kind, "L")] |= LETTER
    got[kind == "Nd"] |= DIGIT
    got[np.char.startswith(kind, "Z")] |= BLANK
    for flag, signs in ((BLANK, " \t\n\r\f\v"), (CODE, "{}();=<>[]"), (BRACKET, "{}()=<>[]"), (BROKEN, "ÃÂâ€™�ï¿½Ðÿ¤œŠ"), (PART, ",;|•·"), (DASH, "–/")):
        got[[ord(c) for c in signs]] |= flag
    return got


class Chars:
    """Characters of a batch of strings by class."""

    def __init__(self, a: pa.Array) -> None:
        self.size = _np(pc.utf8_length(a))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        text = "".join(a.to_pylist())
        self.flags = classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def count(self, flag: int) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(self.flags & flag), self.at))


def _np(a: pa.Array, kind: type = np.int64) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(kind)


def _has(a: pa.Array, pattern: str) -> np.ndarray:
    return _np(pc.match_substring_regex(a, pattern), bool)


def _among(a: pa.Array, some: np.ndarray, f) -> np.ndarray:
    """``f`` of the chosen strings, 0 for the others."""
    out = np.zeros(len(a), np.int64)
    if some.any():
        out[some] = f(a.filter(pa.array(some)))
    return out


def _count(a: pa.Array, pattern: str) -> np.ndarray:
    return _np(pc.count_substring_regex(a, pattern))


def _gone(pattern: str):
    """Characters that a pattern covers."""
    return lambda a: _np(pc.utf8_length(a)) - _np(pc.utf8_length(pc.replace_substring_regex(a, pattern, "")))


def _lines(texts: pa.Array, breaks: str) -> tuple[pa.Array, np.ndarray]:
    """Lines that are not blank, and the text of each."""
    lists = pc.split_pattern_regex(texts, breaks)
    flat, of = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.not_equal(pc.utf8_trim_whitespace(flat), "")
    return flat.filter(keep), _np(of.filter(keep))


def _table_rows(lines: pa.Array, of: np.ndarray, n_docs: int) -> np.ndarray:
    """Which lines are rows of a table: at least two rows of a text with three or more short cells, cut
    alike, of which a quarter are numbers, or which are set apart by bars, tabs or columns in three rows or
    more; rules and headers beside them count too."""
    n = np.ones(len(lines), np.int64)
    kind = np.zeros(len(lines), np.int64)
    bare = pc.utf8_trim_whitespace(lines)
    barred = _np(pc.starts_with(bare, "|"), bool)
    for k, d in enumerate(_DELIMS[:4]):
        c = _np(pc.count_substring(lines, d))
        more = c >= n + (d == ",")
        n, kind = np.where(more, c + 1 - (barred if d == "|" else 0), n), np.where(more, k, kind)
    columns = np.where(n < 3, _among(bare, n < 3, lambda a: _count(a, r"[\s\p{Z}]{2,}") + 1), 0)
    n, kind = np.where(columns >= 3, columns, n), np.where(columns >= 3, 4, kind)
    cut = np.flatnonzero((n >= 3) & (_np(pc.utf8_length(lines)) <= 60 * n))
    out = np.zeros(len(lines), bool)
    if not len(cut):
        return out
    _, group = np.unique(np.stack([of[cut], kind[cut], n[cut]]), axis=1, return_inverse=True)
    group = group.ravel()
    rows = np.bincount(group)
    cut, group = cut[rows[group] >= 2], group[rows[group] >= 2]
    cells, numbers, words, odd = (np.zeros(len(rows)) for _ in range(4))
    for k, d in enumerate(_DELIMS):
        mine = np.flatnonzero(kind[cut] == k)
        if not len(mine):
            continue
        part = bare.take(pa.array(cut[mine]))
        lists = pc.split_pattern_regex(part, r"[\s\p{Z}]{2,}") if d == "  " else pc.split_pattern(pc.utf8_trim(part, characters="|"), d)
        flat, g = pc.utf8_trim_whitespace(lists.flatten()), group[mine][_np(pc.list_parent_indices(lists))]
        cells += np.bincount(g, minlength=len(rows))
        numbers += np.bincount(g, _np(pc.match_substring_regex(flat, _NUMBER)), len(rows))
        words += np.bincount(g, _count(flat, r"[^\s\p{Z}]+"), len(rows))
        odd += np.bincount(g, _np(pc.match_substring_regex(flat, r"[^\s\p{Z}\p{P}]")), len(rows))
    apart = np.zeros(len(rows), bool)
    apart[group[(kind[cut] == 1) | (kind[cut] == 4) | ((kind[cut] == 0) & barred[cut])]] = True
    ok = ((numbers >= 0.25 * cells) | (apart & (rows >= 3) & (odd >= 0.7 * cells))) & (words <= 3 * cells)
    out[cut] = ok[group]
    tabled = np.bincount(of, out, n_docs)[of] > 0
    beside = tabled & ~out & (_np(pc.utf8_length(bare)) > 2)
    return out | (beside & ((_among(lines, beside, lambda a: _has(a, _RULE_LINE)) > 0) | ((n >= 3) & barred)))


def _segments(lines: pa.Array, of: np.ndarray, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments, the text of each, whether it is a whole line, whether it is a table row; and which texts
    were cut inside a run without blanks."""
    long = np.flatnonzero(_np(pc.utf8_length(lines)) > PIECE)
    pieces, count, inside = [], np.ones(len(lines), np.int64), []
    for i in long:
        x, at, k = lines[int(i)].as_py(), 0, 0
        while at < len(x):
            z = len(x) if len(x) - at <= PIECE else x.rfind(" ", at + PIECE // 2, at + PIECE)
            if z <= at:
                z = at + PIECE
                inside.append(of[i])
            pieces.append(x[at:z])
            at, k = z, k + 1
        count[i] = k
    row = np.repeat(np.arange(len(lines)), count)
    whole = np.ones(len(lines), bool)
    whole[long] = False
    take = row.copy()
    take[~whole[row]] = len(lines) + np.arange(len(pieces))
    seg = pa.concat_arrays([lines, pa.array(pieces, pa.string())]).take(pa.array(take))
    return seg, of[row], whole[row], table[row], np.unique(np.array(inside, np.int64))


def _words(a: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    lists = pc.split_pattern_regex(pc.utf8_lower(a), r"[^\p{L}\p{N}]+")
    flat, of = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.not_equal(flat, "")
    return flat.filter(keep).dictionary_encode(), _np(of.filter(keep))


def _distinct(of: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """How many distinct codes each of n groups has."""
    top = np.int64(code.max(initial=0) + 1)
    pair = np.sort(of * top + code)
    return np.bincount(pair[np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]] // top, minlength=n)


def _div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


class Judge:
    """Statistics and forms of texts. ``common``: lower-case common words."""

    def __init__(self, common: list[str]) -> None:
        self.common = pa.array(sorted(set(common)), pa.string())
        self.function = pa.array(sorted({*common, *_FUNCTION_WORDS}), pa.string())
        self.furniture = pa.array(_FURNITURE, pa.string())

    def _words_of(self, tok: pa.DictionaryArray, of: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """Sums over the words of each of n strings; what a word is like is asked once per distinct word."""
        word, code = tok.dictionary, _np(tok.indices)
        size = _np(pc.utf8_length(word))
        add = lambda x: np.bincount(of, x[code], n)
        return {
            "words": np.bincount(of, minlength=n), "chars": add(size), "common": add(_np(pc.is_in(word, value_set=self.common))), "alpha": add(_np(pc.match_substring_regex(word, r"\p{L}"))),
            "function": add(_np(pc.is_in(word, value_set=self.function), bool) & (size > 1)),  # the letter of a share class is no word
            "furniture": add(_np(pc.is_in(word, value_set=self.furniture))), "odd": add(_np(pc.match_substring_regex(word, _ODD))),
            "distinct": _distinct(of, code, n),
        }

    def __call__(self, texts: list[str]) -> pd.DataFrame:
        n_docs, whole_texts = len(texts), pa.array(texts, pa.string())
        lines, of = _lines(whole_texts, _BREAKS)
        a, d, whole, table, inside = _segments(lines, of, _table_rows(lines, of, n_docs))
        n = len(a)
        by = lambda x: np.bincount(d, x, n_docs)
        bare = pc.utf8_trim_whitespace(a)
        chars = Chars(bare)
        size, letters, digits, blanks = chars.size, chars.count(LETTER), chars.count(DIGIT), chars.count(BLANK)
        symbols = np.maximum(size - letters - digits - blanks, 0)
        code, brackets, broken, parts = (chars.count(f) for f in (CODE, BRACKET, BROKEN, PART))
        parts += _among(bare, chars.count(DASH) > 0, lambda x: _count(x, r"\s[–/]\s")) + 1
        linked = _has(a, r"https?://|www\.")
        plain = a
        if linked.any():
            less = pc.replace_substring_regex(a.filter(pa.array(linked)), r"\(?https?://[^\s)]*\)?|www\.[^\s)]*", "")
            plain, c = pc.replace_with_mask(a, pa.array(linked), less), Chars(less)
            code[linked], brackets[linked] = c.count(CODE), c.count(BRACKET)
        tok, at = _words(a)
        w = self._words_of(tok, at, n)
        words = w["words"]
        bullet = _has(a, _BULLET) & whole
        ends, ellipsis = _has(a, _ENDS), _has(a, r"(?:\.\.\.|…)\s*$")
        plain_words = _among(plain, bullet, lambda x: _count(x, r"[\p{L}\p{N}][\p{L}\p{N}'.-]*"))
        tags = _among(a, _np(pc.match_substring(a, "<"), bool), _gone(r"</?[A-Za-z!][^<>]{0,300}>"))
        encoded = _among(plain, _has(plain, r"[A-Za-z0-9+/=]{28}"), _gone(r"[A-Za-z0-9+/=]{28,}"))
        furniture = _div(w["furniture"], words)
        same = _distinct(d, _np(bare.dictionary_encode().indices), n_docs)
        segs = np.bincount(d, minlength=n_docs)
        link = linked & (_np(pc.utf8_length(pc.utf8_trim_whitespace(plain))) == 0)
        stub = whole & (((words <= 3) & (words > 0) & ~ends) | link)
        stubs = by(stub)
        stat = {
            "table_row": table, "bullet": bullet, "plain_words": plain_words, "sentence": ends & (plain_words > 4), "parts": parts, "words": words, "words_a_part": words / np.maximum(parts, 1),
            "function_share": _div(w["function"], words), "distinct_share": np.where(words > 0, _div(w["distinct"], words), 0.0), "odd_share": _div(w["odd"], words), "furniture_share": furniture,
            "page_furniture": (furniture > 0.6) & (words >= 6) & (parts >= 4), "bracket_share": _div(brackets, size), "code_share": _div(code, size), "broken_share": _div(broken, size), "tag_share": _div(tags, size),
            "encoded_share": _div(encoded, size), "text_share": _div(letters + digits, size), "dup_line": ((segs >= 5) & (same <= segs * 0.4))[d], "stub_line": stub & (stubs >= 4)[d] & (stubs >= 0.7 * segs)[d],
        }
        rule = np.full(n, len(SEGMENT_RULES))
        for k, (_, _, conditions) in reversed(list(enumerate(SEGMENT_RULES))):
            ok = np.ones(n, bool)
            for name, lo, hi in conditions:
                v = stat[name]
                ok &= (v >= lo if lo is not None else True) & (v <= hi if hi is not None else True)
            rule[ok] = k
        form_of = np.array([FORMS.index(f) for _, f, _ in SEGMENT_RULES] + [0])
        held = np.stack([by(size * (form_of[rule] == k)) for k in range(4)])
        total = held.sum(axis=0)
        best = np.where(held[0] * 2 >= total, 0, held[1:].argmax(axis=0) + 1)
        # words of whole texts: those that were cut inside a run without blanks are counted again
        of_text = {k: by(w[k]) for k in ("words", "chars", "common", "alpha")}
        if len(inside):
            tok, at = _words(whole_texts.take(pa.array(inside)))
            for k, v in self._words_of(tok, at, len(inside)).items():
                if k in of_text:
                    of_text[k][inside] = v
        lines, of = _lines(whole_texts, r"\n")
        count = of_text["words"].astype(np.int64)
        ones = np.bincount(d, minlength=n_docs)
        out = pd.DataFrame(
            {
                "n_words": count,
                "mean_word_length": _div(of_text["chars"], count),
                "symbol_ratio": _div(by(symbols), by(size - blanks)),
                "punct_line_share": _div(np.bincount(of, _has(lines, _ENDS), n_docs), np.bincount(of, minlength=n_docs)),
                "common_share": _div(of_text["common"], count),
                "bullet_share": _div(by(bullet), np.maximum(by(whole), ones)),
                "ellipsis_share": _div(by(ellipsis), ones),
                "alpha_share": _div(of_text["alpha"], count),
                "form": [FORMS[k] for k in best],
                "prose_share": np.where(total > 0, held[0] / np.maximum(total, 1), 1.0),
            }
        )
        failed = [[] for _ in range(n_docs)]
        for name, key, lo, hi in RULES:
            v = out[key].to_numpy()
            for i in np.flatnonzero((v < lo if lo is not None else False) | (v > hi if hi is not None else False)):
                failed[i].append(name)
        by_rule = [by(size * (rule == k)) for k in range(len(SEGMENT_RULES))]
        for k, (name, f, _) in enumerate(SEGMENT_RULES):
            for i in np.flatnonzero((best == FORMS.index(f)) & (by_rule[k] > 0)):
                failed[i].append(name)
        for i in np.flatnonzero(best > 0):
            failed[i].append("form_" + FORMS[best[i]])
        out["reasons"] = failed
        return out


def quality(df: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word", most: int = 5000) -> DataFrame:
    """Statistics, form and failed rules of every row with a text.

    Null texts are left out; an empty or blank text has zero words and is prose. ``words`` is a
    list of common words, which is sent to the tasks whole; one of more than ``most`` words is refused. Texts are read whole, whatever their length. A map over the rows.
    """
    rank = [c for c in ("rank_no",) if c in words.columns]
    common = [r[0] for r in words.where(F.col(word_col).isNotNull()).orderBy(*rank, word_col).select(F.lower(word_col)).limit(most + 1).collect()]
    if len(common) > most:
        raise ValueError(f"more than {most} common words")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(common)
        for b in batches:
            at = 0
            while at < len(b):
                z, chars = at, 0
                while z < len(b) and (z == at or chars + len(b["text"].iat[z]) <= SLICE_CHARS):
                    chars += len(b["text"].iat[z])
                    z += 1
                out = judge(b["text"].iloc[at:z].tolist())
                out.insert(0, "doc_id", b["doc_id"].iloc[at:z].to_numpy())
                yield out
                at = z

    return spread(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInPandas(run, OUT)
