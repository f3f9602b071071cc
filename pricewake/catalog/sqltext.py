"""DuckDB wording of the text expressions, for the SQL twins."""

from __future__ import annotations

from pricewake.functions import text as X
from pricewake.functions.brands import BRANDS, LINE_BRANDS, brand_dim
from pricewake.functions.pricing import SALES


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_BLANKS = " || ".join(f"chr({ord(c)})" for c in X.WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def sub(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {to}, 'g')"


def extract(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {quoted(pattern)}, {group})"


def double(x: str) -> str:
    return f"try_cast(nullif({x}, '') AS DOUBLE)"


def number(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({strip(x)}, {quoted(X.NUMBER)}) "
        f"THEN try_cast({strip(x)} AS DOUBLE) END"
    )


def lines(body: str) -> str:
    pieces = f"regexp_split_to_array(coalesce({body}, ''), {quoted(X.LINE_BREAK)})"
    return f"list_filter(list_transform({pieces}, lambda l: {strip('l')}), lambda l: l <> '')"


def fragments(line: str) -> str:
    # RE2 has no lookahead: thousands commas are put aside while splitting.
    mark = "chr(1) || '\\1\\2'"
    once = sub(line, r",(\d{3})(\D|$)", mark)
    safe = sub(once, r",(\d{3})(\D|$)", mark)
    pieces = f"regexp_split_to_array({safe}, ' and |,')"
    restored = strip("replace(f, chr(1), ',')")
    return f"list_filter(list_transform({pieces}, lambda f: {restored}), lambda f: f <> '')"


def without_emoji(x: str) -> str:
    return sub(x, X.EMOJI)


def is_struck(x: str) -> str:
    return f"regexp_matches({x}, {quoted(X.STRUCK)})"


def _list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def is_informative(x: str) -> str:
    known = _list([b.lower() for b in LINE_BRANDS])
    return (
        f"(NOT contains(lower({x}), 'imgur.com') AND (regexp_matches({x}, '\\p{{Nd}}') OR "
        f"len(list_filter({known}, lambda b: contains(lower({x}), b))) > 0))"
    )


def kept_lines(body: str) -> str:
    plain = f"list_transform({lines(body)}, lambda l: {without_emoji('l')})"
    return f"list_filter({plain}, lambda l: {is_informative('l')})"


def is_sale_post(title: str, mode: str) -> str:
    sale = f"contains(upper({title}), '[WTS]')"
    one = f"contains(lower({title}), '(bottle)')"
    many = f"contains(lower({title}), '(bottles)')"
    wanted = {"any": sale, "strict": f"{sale} AND {one}", "plural": f"{sale} AND ({one} OR {many})"}
    return f"coalesce({wanted[mode]}, false)"


def brand_of(x: str, brands=BRANDS) -> str:
    return f"list_filter({_list(brands)}, lambda b: contains(lower({x}), lower(b)))[1]"


def alias_of(x: str) -> str:
    rows = ", ".join(
        f"{{'alias': {quoted(a)}, 'canonical': {quoted(c)}}}" for _, a, c in brand_dim()
    )
    return f"list_filter([{rows}], lambda b: contains(lower({x}), lower(b.alias)))[1]"


def without_alias(x: str, alias: str) -> str:
    gone = f"regexp_replace({x}, regexp_escape({alias}), '', 'gi')"
    return f"CASE WHEN {alias} IS NULL THEN {x} ELSE {strip(gone)} END"


def without_brand(x: str, brand: str) -> str:
    gone = strip(f"replace({x}, {brand}, '')")
    return f"CASE WHEN {brand} IS NULL THEN {x} ELSE {gone} END"


def clean_item_name(x: str) -> str:
    out = sub(sub(x, X.URL), X.PARENTHESISED)
    for word in X.DESCRIPTORS:
        out = f"replace({out}, {quoted(word)}, '')"
    return strip(sub(sub(out, "[-*]"), f"[{X.WS}]+", "' '"))


def size_ml(x: str) -> str:
    sizes = f"string_split({extract(x, X.SIZE, 1)}, '/')"
    return f"list_max(list_transform({sizes}, lambda n: {double(strip('n'))}))"


def price_usd(x: str) -> str:
    return double(f"replace({extract(x, X.PRICE, 1)}, ',', '')")


def fill_percent(x: str, size: str) -> str:
    measured = f"{double(extract(x, X.FILL_ML, 1))} / nullif({size}, 0) * 100"
    return f"coalesce({double(extract(x, X.FILL, 1))}, {measured})"


def status_of(x: str) -> str:
    cases = " ".join(f"WHEN contains(upper({x}), '{s}') THEN '{s}'" for s in X.STATUSES)
    return f"CASE {cases} END"


def market_name(x: str) -> str:
    return f"upper({strip(sub(x, X.PARENTHESISED))})"


def plain_name(x: str) -> str:
    return strip(sub(sub(x, X.PARENTHESISED), f"[^a-zA-Z0-9{X.WS}]"))


def search_text(x: str) -> str:
    return "trim(" + sub(f"lower(coalesce({x}, ''))", "[^a-z0-9]+", "' '") + ")"


def retail_size(x: str) -> str:
    return f"nullif({extract(x, X.RETAIL_SIZE, 0)}, '')"


def seller_weight(flair: str) -> str:
    sales = f"coalesce({double(extract(flair, SALES, 1))}, 0)"
    return (
        f"CASE WHEN {flair} IS NULL THEN CAST(1 AS DOUBLE) "
        f"WHEN {sales} <= 15 THEN {sales} * {sales} "
        f"ELSE CAST(450 AS DOUBLE) * ln({sales}) - CAST(993 AS DOUBLE) END"
    )


def full_bottle_price(price: str, fill: str) -> str:
    percent = f"least(coalesce({fill}, CAST(100 AS DOUBLE)), CAST(100 AS DOUBLE))"
    return f"CASE WHEN {percent} > 0 THEN {price} / ({percent} / CAST(100 AS DOUBLE)) END"


def rounded(x: str, digits: int = 4) -> str:
    return f"round({x}, {digits})"
