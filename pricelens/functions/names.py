"""Product names as Column expressions: normal form, tokens, brand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import vocabulary as V


def strings(values) -> Column:
    """A literal array of strings."""
    return F.array(*map(F.lit, values)).cast("array<string>")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def stripped(name: Column, patterns) -> Column:
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, name))


def strip_sku(name: Column) -> Column:
    """Without a labelled SKU at the end; a bare code stays, since it often names the variant."""
    return stripped(name, V.SKU_TAILS)


def strip_pack(name: Column) -> Column:
    return stripped(name, V.PACK_TAILS)


def strip_noise(name: Column, shops=()) -> Column:
    """Without selling phrases or ``shops`` at the end."""
    return stripped(name, [*V.NOISE_TAILS, *(rf"(?i)\s*[-—–|]\s*{s}(\.[a-z]+)?\s*$" for s in shops)])


def fix_mojibake(text: Column) -> Column:
    """UTF-8 text that was read as Windows-1252, restored; other text, and what isn't UTF-8 after that, as it is. No Python."""
    marked = reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in V.MOJIBAKE))
    latin = F.translate(text, V.CP1252, "".join(map(chr, V.CP1252_BYTES)))
    whole = ~text.rlike("[\u0080-\u009f]") & ~latin.rlike("[^\u0000-\u00ff]")
    restored = F.encode(latin, "ISO-8859-1").cast("string")
    return F.when(marked & whole, F.when(F.is_valid_utf8(restored), restored).otherwise(text)).otherwise(text)


def normalize(name: Column, shops=()) -> Column:
    """The form in which names are compared: mojibake repaired, tails off, single-letter prefixes joined, spaces of any kind single; case kept."""
    clean = strip_noise(strip_pack(strip_sku(F.regexp_replace(fix_mojibake(name), r"(?U)\s+", " "))), shops)
    clean = F.regexp_replace(clean, r"\b([a-zA-Z])-([a-zA-Z])", "$1$2")
    return F.trim(F.regexp_replace(clean, r"\s+", " "))


def product_key(name: Column) -> Column:
    return F.trim(F.lower(normalize(name)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; a number and a unit after it are one token."""
    join = r"(?<![a-z0-9])([0-9]+)[^a-z0-9]+(" + "|".join(sorted(V.UNITS, key=len, reverse=True)) + r")(?![a-z0-9])"
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), join, "$1$2"), F.lit("[a-z0-9]+"), F.lit(0))


def distinguishing(text: Column) -> Column:
    return F.array_except(tokens(text), strings(V.STOPWORDS))


def specific(text: Column) -> Column:
    """Distinguishing tokens of six characters or more that are no numbers."""
    return F.filter(distinguishing(text), lambda t: (F.length(t) >= 6) & ~t.rlike("^[0-9]+$"))


def stem(word: Column) -> Column:
    """Without a plural s."""
    plural = (F.length(word) > 3) & F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss"))
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def brand(name: Column) -> Column:
    """The leading run of letters and digits. A first word of three or more hyphenated parts counts whole; a single letter gives way to a proper word after it."""
    lead = lambda w: F.lower(F.coalesce(F.nullif(F.regexp_extract(w, r"(?i)^[a-z0-9]+", 0), F.lit("")), w))

    def pick(parts: Column) -> Column:
        first, second = F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.get(parts, F.lit(1))
        coined = F.regexp_replace(F.lower(first), "[^a-z0-9]", "")
        whole = (F.length(first) - F.length(F.replace(first, F.lit("-"), F.lit(""))) >= 2) & first.rlike("[a-zA-Z]") & (F.length(coined) >= 4)
        initial = lambda own, next_: own.rlike("^[a-z]$") & next_.rlike("^[a-z]{3,}$") & ~next_.isin(*V.NOT_BRANDS)
        return F.when(whole, coined).when(F.coalesce(initial(lead(first), lead(second)), F.lit(False)), lead(second)).otherwise(lead(first))

    return let(F.split(F.trim(name), r"\s+"), pick)


def base_name(name: Column) -> Column:
    """The name of the group of variants: without set sizes, measures, size and configuration words and short codes."""
    return reduce(lambda c, s: F.regexp_replace(c, *s), V.BASE_STEPS, name)


def paren_code(name: Column) -> Column:
    """What the last parentheses hold, in lower case; null without any."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.get(F.reverse(F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), F.lit(1))), F.lit(0))), r"\s+", " ")), F.lit(""))


def looks_like_code(text: Column) -> Column:
    """Short, with a digit, and neither a measure nor a word for a pack or a grade."""
    return (F.coalesce(text, F.lit("")) != "") & (F.length(text) <= 24) & text.rlike(r"\d") & ~text.rlike(V.NO_CODE)


def merchant_key(text: Column) -> Column:
    """A merchant's name or host without protocol, path, top-level domain and punctuation."""
    host = F.split(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "^https?://", ""), "/")[0]
    return F.regexp_replace(F.regexp_replace(host, V.TOP_DOMAIN, ""), "[^a-z0-9]", "")
