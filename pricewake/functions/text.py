"""Text expressions over posts, lines and fragments. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewake.functions.brands import BRANDS, LINE_BRANDS, brand_dim

# --- fixed values ---
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters for use inside a regex class.
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
# Where blank lines are dropped anyway the two halves of a CRLF may each end a line; one class is found faster.
_LINE_END = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
# A run of blanks that is not one plain space.
_ODD_BLANKS = (
    r"[\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    rf"[{WS}]*| [{WS}]+"
)
# A comma in front of exactly three digits belongs to a number.
FRAGMENT_BREAK = r" and |,(?!\d{3}(?!\d))"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2700}-\x{27BF}\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}\x{2B00}-\x{2BFF}\x{200D}]+"
)
STRUCK = "~~.*~~"
URL = rf"https?://[^{WS}]+"
PARENTHESISED = r"\([^\n]*?\)"
DESCRIPTORS = ["see level", "full presentation", "BNIB", "shipped", "SOLD", "🚢", "~", "**"]
SIZE = rf"(?i)((?:\d+(?:\.\d+)?[{WS}]*/[{WS}]*)*\d+(?:\.\d+)?)[{WS}]*ml"
PRICE = rf"\$[{WS}]*((?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?)"
FILL = rf"(\d{{1,3}})[{WS}]?%"
FILL_ML = rf"(?i)≈(\d+)[{WS}]?ml"
STATUSES = ["SOLD", "AVAILABLE", "LISTED"]
RETAIL_SIZE = rf"(\d+(\.\d+)?)[{WS}]*(OZ|ML)"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# --- end of fixed values ---


def strip(c: Column) -> Column:
    """Trim every Unicode blank, not only the space that ``trim`` knows."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def number(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


# ---- one of many names -----------------------------------------------------


_BRANCHES = 5


def _any_of(words: Sequence[str]) -> str:
    """One pattern for many words, shared beginnings written once, longest first."""
    tails: dict[str, list[str]] = {}
    for word in words:
        if word:
            tails.setdefault(word[0], []).append(word[1:])
    branches = []
    for first, rest in sorted(tails.items()):
        more = _any_of([r for r in rest if r])
        if len(rest) == 1:
            branches.append(re.escape(first + rest[0]))
        else:
            branches.append(f"{re.escape(first)}(?:{more})" + ("?" if "" in rest else ""))
    if len(branches) <= _BRANCHES:
        return "|".join(branches)
    # Many first letters: look at the letter before trying the words of its part.
    firsts = sorted(tails)
    parts = []
    for at in range(0, len(branches), _BRANCHES):
        letters = "".join(re.escape(c) for c in firsts[at : at + _BRANCHES])
        parts.append(f"(?=[{letters}])(?:{'|'.join(branches[at : at + _BRANCHES])})")
    return "|".join(parts)


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    return lowered.rlike(_any_of([w.lower() for w in words]))


def first_of(lowered: Column, words: Sequence[str], word_bound: bool = False) -> Column:
    """Index of the first word, in list order, that a lower-cased text contains.

    One pass over the text finds the longest word at every position; a found
    word also stands for the listed words inside it.
    """
    low = [w.lower() for w in words]
    pad = " " if word_bound else ""
    best = {
        word: min(i for i, other in enumerate(low) if f"{pad}{other}{pad}" in f"{pad}{word}{pad}")
        for word in low
    }
    edge = r"[\p{L}\p{N}]"
    any_word = f"({_any_of(list(best))})"
    pattern = f"(?<!{edge}){any_word}(?!{edge})" if word_bound else any_word
    found = F.regexp_extract_all(lowered, F.lit(f"(?={pattern})"), F.lit(1))
    rank = F.create_map(*[F.lit(x) for pair in best.items() for x in pair])
    return F.array_min(F.transform(found, lambda w: F.element_at(rank, w)))


# ---- posts and lines -------------------------------------------------------


def is_sale_post(title: Column, mode: str = "strict") -> Column:
    """Whether a title offers bottles: ``strict``, ``plural`` or ``any`` sale."""
    sale = F.contains(F.upper(title), F.lit("[WTS]"))
    bottle = F.contains(F.lower(title), F.lit("(bottle)"))
    if mode == "any":
        wanted = sale
    elif mode == "strict":
        wanted = sale & bottle
    elif mode == "plural":
        wanted = sale & (bottle | F.contains(F.lower(title), F.lit("(bottles)")))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(wanted, F.lit(False))


def lines(body: Column) -> Column:
    """The trimmed, non-blank lines of a text, in order; a null text has none."""
    split = F.split(F.coalesce(body, F.lit("")), _LINE_END)
    return F.filter(F.transform(split, strip), lambda x: x != "")


def fragments(line: Column) -> Column:
    """The parts of a line that may each offer one item."""
    return F.filter(F.transform(F.split(line, FRAGMENT_BREAK), strip), lambda x: x != "")


def without_emoji(c: Column) -> Column:
    # Text of one byte a letter holds none.
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(c, EMOJI, ""))


def is_struck(line: Column) -> Column:
    return F.contains(line, F.lit("~~")) & line.rlike(STRUCK)


def is_informative(line: Column, brands: Sequence[str] = LINE_BRANDS) -> Column:
    """No picture link, and a digit or a known brand somewhere."""
    low = F.lower(line)
    return ~F.contains(low, F.lit("imgur.com")) & (
        line.rlike(r"\p{Nd}") | contains_any(low, brands)
    )


# ---- fields of a fragment --------------------------------------------------


def brand_of(lowered: Column, brands: Sequence[str] = BRANDS, word_bound: bool = False) -> Column:
    """First brand in list order that occurs in an already lower-cased text."""
    names = F.array(*[F.lit(b) for b in brands])
    return F.get(names, first_of(lowered, brands, word_bound))


def alias_of(lowered: Column, dim=None) -> Column:
    """First alias, in table order, that occurs in a lower-cased text: ``(alias, canonical)``."""
    rows = sorted(brand_dim() if dim is None else dim)
    known = F.array(
        *[F.struct(F.lit(a).alias("alias"), F.lit(c).alias("canonical")) for _, a, c in rows]
    )
    return F.get(known, first_of(lowered, [a for _, a, _ in rows]))


def without_alias(text: Column, alias: Column) -> Column:
    """The text without an alias in any letter case; unchanged when there is none."""
    pattern = F.concat(F.lit("(?iu)\\Q"), alias, F.lit("\\E"))
    return F.coalesce(strip(F.regexp_replace(text, pattern, F.lit(""))), text)


def without_brand(name: Column, brand: Column) -> Column:
    """Take the brand out as spelled, in exactly its letter case."""
    return F.when(brand.isNull(), name).otherwise(strip(F.replace(name, brand, F.lit(""))))


def clean_item_name(name: Column) -> Column:
    """Drop links, asides, selling words and decoration; collapse blanks."""
    out = F.when(F.contains(name, F.lit("://")), F.regexp_replace(name, URL, "")).otherwise(name)
    out = F.regexp_replace(out, PARENTHESISED, "")
    for word in [*DESCRIPTORS, "-", "*"]:
        out = F.replace(out, F.lit(word), F.lit(""))
    return strip(F.regexp_replace(out, _ODD_BLANKS, " "))


def _holds(text: Column, *parts: str) -> Column:
    """Whether one of the parts stands in a text: a plain search that spares most texts the pattern."""
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(text, F.lit(part))
    return found


def size_ml(text: Column) -> Column:
    """``50ml`` is 50, ``45/50 ml`` is 50, ``7.5ml`` is 7.5."""
    sizes = F.split(F.regexp_extract(text, SIZE, 1), "/")
    size = F.array_max(F.transform(sizes, lambda n: strip(n).try_cast("double")))
    return F.when(_holds(text, "ml", "mL", "ML", "Ml"), size)


def price_usd(text: Column) -> Column:
    """The number after the first ``$`` that has one, with its thousands and cents."""
    price = F.replace(F.regexp_extract(text, PRICE, 1), F.lit(","), F.lit("")).try_cast("double")
    return F.when(_holds(text, "$"), price)


def fill_percent(text: Column, size: Column) -> Column:
    """A percentage, or else an approximate content measured against the size."""
    percent = F.when(_holds(text, "%"), F.regexp_extract(text, FILL, 1).try_cast("double"))
    content = F.when(_holds(text, "≈"), F.regexp_extract(text, FILL_ML, 1).try_cast("double"))
    measured = F.when(size != 0, content / F.nullif(size, F.lit(0.0)) * 100)
    return F.coalesce(percent, measured)


def status_of(text: Column) -> Column:
    up = F.upper(text)
    out = F.lit(None).cast("string")
    for status in reversed(STATUSES):
        out = F.when(F.contains(up, F.lit(status)), F.lit(status)).otherwise(out)
    return out


def is_listing(price: Column, size: Column) -> Column:
    """A fragment counts when it names a price or a size other than zero."""
    return (F.coalesce(price, F.lit(0.0)) != 0) | (F.coalesce(size, F.lit(0.0)) != 0)


# ---- names -----------------------------------------------------------------


def market_name(name: Column) -> Column:
    """The key of an item: asides removed, trimmed, upper case."""
    return F.upper(strip(F.regexp_replace(name, PARENTHESISED, "")))


def plain_name(name: Column) -> Column:
    """Letters, digits and blanks only, asides removed."""
    out = F.regexp_replace(name, PARENTHESISED, "")
    return strip(F.regexp_replace(out, f"[^a-zA-Z0-9{WS}]", ""))


def search_text(c: Column) -> Column:
    """Lower case, everything but ``a-z0-9`` squeezed to one space; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def retail_size(product: Column) -> Column:
    return blank_to_null(F.regexp_extract(product, RETAIL_SIZE, 0))


def retail_number(price: Column) -> Column:
    return number(F.translate(price, "$,", ""))
