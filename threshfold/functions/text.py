"""Text columns: hygiene, symbols, names, windows, lexical stance. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of the lexical stance floor.
BULLISH = ("undervalued", "cheap", "buying", "bought", "long ", "accumulating", "great business", "wide moat", "compounder", "bargain", "margin of safety", "load up", "conviction", "adding to")
BEARISH = ("overvalued", "value trap", "avoid", "selling", "sold", "short ", "bagholder", "dying", "declining", "melting ice", "expensive", "bubble", "red flag", "accounting fraud")
QUESTION = ("?", "thoughts on", "am i missing", "talk me out", "what do you think", "any thoughts", "opinions on")
# What text hygiene takes out, in this order, and what it puts there.
HYGIENE = (
    (r"(?s)```.*?```|`[^`]*`", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"https?://\S+|www\.\S+", " "),
    (r"(?md)^[ \t]*(?:&gt;|>).*$", " "),
)
# Words that company names end with.
NAME_SUFFIXES = ("corp", "corporation", "inc", "incorporated", "co", "company", "ltd", "limited", "plc", "holdings?", "group", "the", "sa", "nv", "ag", "llc", "lp", "trust", "reit", "class [abc]", "adr", "new", "com")


def document_text(kind: Column, title: Column, selftext: Column, body: Column) -> Column:
    """A post is title, newline, selftext; a comment its body. Nulls are empty."""
    e = F.lit("")
    return F.when(kind == "post", F.concat(F.coalesce(title, e), F.lit("\n"), F.coalesce(selftext, e))).otherwise(F.coalesce(body, e))


def clean_text(c: Column) -> Column:
    """Without code, link targets, addresses and quoted lines, in that order; null is empty."""
    c = F.coalesce(c, F.lit(""))
    for pattern, by in HYGIENE:
        c = F.regexp_replace(c, pattern, by)
    return c


def clean_text_sql(c: str) -> str:
    c = f"regexp_replace(coalesce({c}, ''), '```.*?```|`[^`]*`', ' ', 'gs')"
    c = f"regexp_replace({c}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"
    c = f"regexp_replace({c}, 'https?://\\S+|www\\.\\S+', ' ', 'g')"
    return f"regexp_replace({c}, '(?m)^[ \\t]*(?:&gt;|>).*$', ' ', 'g')"


def cashtags(c: Column) -> Column:
    """``$ABC`` and ``$ABC.B`` as written, without the sign; a class is joined with ``-``."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\$([A-Z]{1,5}(?:\.[A-Z])?)\b"), 1), lambda x: F.replace(x, F.lit("."), F.lit("-")))


def removed(category: Column, *bodies: Column) -> Column:
    """True where a moderator's category is given or a body is a marker of removal; never null."""
    out = F.coalesce(category != "", F.lit(False))
    for b in bodies:
        out = out | F.coalesce(b.isin("[deleted]", "[removed]"), F.lit(False))
    return out


def normalise_name(c: Column) -> Column:
    """A company name in lower case, without punctuation and legal suffix words, blanks squeezed."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9& ]", " ")
    c = F.regexp_replace(c, r"\b(?:" + "|".join(NAME_SUFFIXES) + r")\b", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def count_of(c: Column, phrases: tuple[str, ...]) -> Column:
    """Occurrences of the phrases, each counted without overlap."""
    total = F.lit(0)
    for p in phrases:
        total = total + ((F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return total


def lexical_stance(c: Column) -> Column:
    """``struct(stance, stance_confidence)`` by counting phrases: the floor any classifier must beat."""
    t = F.lower(F.coalesce(c, F.lit("")))
    b, r, q = (count_of(t, p) for p in (BULLISH, BEARISH, QUESTION))
    stance = F.when((q > 0) & (q >= F.greatest(b, r)), "question").when(b > r, "bullish").when(r > b, "bearish").otherwise("neutral")
    return F.struct(stance.alias("stance"), F.when(stance == "neutral", 0.30).otherwise(0.35).alias("stance_confidence"))


def window_around(text: Column, start: Column, end: Column, radius: int) -> Column:
    """The text from ``radius`` before a span to ``radius`` behind it (code points)."""
    a = F.greatest(start - radius, F.lit(0))
    return F.substring(text, a + 1, end + radius - a)


def mark_span(text: Column, start: Column, end: Column, width: int = 1500) -> Column:
    """The text around a span, the span in guillemets, ellipses where something was left out."""
    a, b = F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text))
    return F.concat(
        F.when(a > 0, "…").otherwise(""), F.substring(text, a + 1, start - a), F.lit("«"), F.substring(text, start + 1, end - start), F.lit("»"),
        F.substring(text, end + 1, b - end), F.when(b < F.length(text), "…").otherwise(""),
    )


def strip_tags(c: Column) -> Column:
    """HTML text without tags, ``&amp;`` decoded, blanks squeezed and trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, r"<[^>]*>", ""), F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def table_rows(html: Column, css_class: str = "wikitable") -> Column:
    """Cells of the first table of a class: an array of rows, each an array of stripped cells."""
    t = F.regexp_extract(html, rf'(?s)<table[^>]*class="[^"]*{css_class}[^"]*"[^>]*>(.*?)</table>', 1)
    rows = F.regexp_extract_all(t, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1), strip_tags))


def evidence_tier(token: Column, jargon: tuple[str, ...], rank: Column, common: int) -> Column:
    """JARGON for single letters and jargon, COMMON for words ranked at most ``common``, else CLEAR."""
    return F.when((F.length(token) == 1) | token.isin(*jargon), "JARGON").when(rank <= common, "COMMON").otherwise("CLEAR")
