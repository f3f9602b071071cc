"""Captured shop pages (``url, html``) to links, variants and catalogue rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewake.operators.keyed import first_by

# --- fixed values: the shop's page layout ---
SITE = "https://www.jomashop.com"
ITEM_CLASS = "productItem"
LINK_CLASSES = ["productImg-link", "productName-link", "itemLink"]
VARIANT_CLASS = "child-product"
CONTAINER_CLASS = "child-products-container"
HEADER = "#product-h1-product-name"
SELECTORS = {
    "product": [HEADER],
    "brand": [".brand-name"],
    "size": [".child-product.selected .item-size", ".item-size"],
    "discount_price": [".child-product.selected .item-price", ".now-price span", ".item-price"],
    "retail_price": [".retail-wrapper span:not(.retail-label)"],
}
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
]
# --- end of fixed values ---

# After a blank or a quote, so that data-href is another attribute; quoted or bare.
_HREF = r"""(?is)[\s"']href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _classed(tag: str, name: str) -> str:
    """Pattern of an opening tag that has a class."""
    return rf"""<{tag}\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["'][^>]*>"""


def _href(tag: Column) -> Column:
    # Only one of the three groups is ever filled.
    link = F.concat(*[F.regexp_extract(tag, _HREF, n) for n in (1, 2, 3)])
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        link = F.replace(link, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(link), F.lit(""))


def first_seen_links(links: DataFrame, page: str) -> DataFrame:
    """Each link once, with the page and position where it first occurs."""
    return first_by(links.select("link", page, "pos"), ["link"], F.col(page), F.col("pos"))


def absolute(link: Column, site: str = SITE) -> Column:
    return F.when(F.startswith(link, F.lit("http")), link).otherwise(F.concat(F.lit(site), link))


def _until_closed(rest: Column, tag: str) -> Column:
    """The text behind an opening tag up to the tag that closes it, nested ones included."""
    pieces = F.split(rest, rf"(?i)(?=</?{tag}\b)", -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("text"))

    def step(state: Column, piece: Column) -> Column:
        opens = F.rlike(piece, F.lit(rf"(?i)^<{tag}\b")).cast("int")
        closes = F.rlike(piece, F.lit(rf"(?i)^</{tag}\b")).cast("int")
        depth = F.when(state["depth"] > 0, state["depth"] + opens - closes).otherwise(0)
        text = F.when(depth > 0, F.concat(state["text"], piece)).otherwise(state["text"])
        return F.struct(depth.alias("depth"), text.alias("text"))

    return F.aggregate(pieces, start, step, lambda state: state["text"])


def variant_urls(
    pages: DataFrame,
    *keep: str,
    variant: str | None = VARIANT_CLASS,
    container: str | None = CONTAINER_CLASS,
    site: str = SITE,
) -> DataFrame:
    """All variant links of a product page, or the page itself when it has none.

    Only links inside the first ``container`` count, and all links of the page without one named.
    """
    opening = _classed("a", variant) if variant else r"<a\b[^>]*>"
    part = F.col("html")
    if container:
        behind = F.get(F.split("html", rf"(?is){_classed('div', container)}", 2), F.lit(1))
        part = F.when(behind.isNotNull(), _until_closed(behind, "div"))
    tags = F.coalesce(
        F.regexp_extract_all(part, F.lit(rf"(?is){opening}"), F.lit(0)),
        F.array().cast("array<string>"),
    )
    hrefs = F.filter(F.transform(tags, _href), lambda h: h.isNotNull())
    full = F.transform(hrefs, lambda h: absolute(h, site))
    urls = F.when(F.size(full) > 0, full).otherwise(F.array("url"))
    return pages.select(*keep, F.posexplode(urls).alias("pos", "variant_url"))


def product_links(
    pages: DataFrame,
    *keep: str,
    item_class: str | None = ITEM_CLASS,
    link_classes: Sequence[str] = tuple(LINK_CLASSES),
    document_order: bool = False,
) -> DataFrame:
    """One link per list item: of its first anchor with a link class, in class order.

    With ``document_order`` it is the first anchor of the item that has any of the classes. Without
    ``link_classes`` any anchor counts; without ``item_class`` any item. Lists inside an item belong to it.
    """
    opening = rf"(?is){_classed('li', item_class)}" if item_class else r"(?is)<li\b[^>]*>"
    behind = F.split("html", opening, -1)
    items = F.transform(
        F.slice(behind, F.lit(2), F.greatest(F.size(behind) - 1, F.lit(0))),
        lambda rest: _until_closed(rest, "li"),
    )
    if not link_classes:
        anchors = [r"(?is)<a\b[^>]*>"]
    elif document_order:
        anchors = [rf"(?is){_classed('a', f'(?:{"|".join(link_classes)})')}"]
    else:
        anchors = [rf"(?is){_classed('a', c)}" for c in link_classes]
    item = F.col("_item")
    link = F.coalesce(*[_href(F.regexp_extract(item, a, 0)) for a in anchors])
    return (
        pages.select(*keep, F.posexplode(items).alias("pos", "_item"))
        .select(*keep, "pos", link.alias("link"))
        .filter(F.col("link").isNotNull())
    )


# ---- fields of a product page ------------------------------------------------


class _Selector:
    """A chain of simple selectors: ``#id``, ``.a.b``, ``tag``, ``:not(.c)``."""

    def __init__(self, text: str):
        self.steps = [self._step(part) for part in text.split()]

    @staticmethod
    def _step(part: str):
        part, _, banned = part.partition(":not(.")
        tag, *classes = part.split(".")
        tag, _, wanted_id = tag.partition("#")
        return tag, wanted_id, set(classes), banned.rstrip(")")

    @staticmethod
    def _fits(step, element) -> bool:
        tag, wanted_id, classes, banned = step
        name, element_id, owned = element
        return (
            (not tag or tag == name)
            and (not wanted_id or wanted_id == element_id)
            and classes <= owned
            and banned not in owned
        )

    def matches(self, path) -> bool:
        """Whether the last element of a path is selected."""
        *outer, last = self.steps
        if not self._fits(last, path[-1]):
            return False
        at = len(path) - 2
        for step in reversed(outer):
            while at >= 0 and not self._fits(step, path[at]):
                at -= 1
            if at < 0:
                return False
            at -= 1
        return True


class _FirstTexts(HTMLParser):
    """Text of the first element that each selector finds."""

    def __init__(self, selectors: dict[str, _Selector]):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.path: list = []
        self.open: dict[str, int] = {}
        self.texts: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        owned = set((values.get("class") or "").split())
        self.path.append((tag, values.get("id"), owned))
        for name, selector in self.selectors.items():
            if name not in self.texts and selector.matches(self.path):
                self.texts[name] = []
                self.open[name] = len(self.path)
        if tag in VOID_TAGS:
            self._close(len(self.path) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close(len(self.path) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.path) - 1, -1, -1):
            if self.path[depth][0] == tag:
                self._close(depth)
                return

    def _close(self, depth: int):
        del self.path[depth:]
        self.open = {name: at for name, at in self.open.items() if at <= depth}

    def handle_data(self, data):
        for name in self.open:
            self.texts[name].append(data)


_PARSED = {s: _Selector(s) for texts in SELECTORS.values() for s in texts}


def page_fields(html: str | None) -> dict[str, str]:
    """The first usable text per field; a missing field is an empty text."""
    parser = _FirstTexts(_PARSED)
    parser.feed(html or "")
    parser.close()
    found = {s: " ".join("".join(t).split()) for s, t in parser.texts.items()}
    fields = {
        field: next((found[s] for s in options if s in found), "")
        for field, options in SELECTORS.items()
    }
    fields["has_header"] = HEADER in found
    fields["has_brand"] = ".brand-name" in found
    return fields


_FIELDS = (
    "url string, brand string, product string, size string, discount_price string, "
    "retail_price string, has_header boolean, has_brand boolean"
)


def read_products(pages: DataFrame) -> DataFrame:
    """Fields of every page, with whether its header and brand are there."""

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame(
                [page_fields(html) for html in batch["html"]],
                columns=[*SELECTORS, "has_header", "has_brand"],
            )
            rows["url"] = batch["url"].to_numpy()
            yield rows[
                ["url", "brand", "product", "size", "discount_price", "retail_price",
                 "has_header", "has_brand"]
            ]

    return pages.select("url", "html").mapInPandas(fields, _FIELDS)


def retail_rows(products: DataFrame, lenient: bool = False) -> DataFrame:
    """Catalogue rows of good pages, exact copies dropped.

    A page without header gives none, nor one without brand unless ``lenient``.
    """
    good = F.col("has_header") if lenient else F.col("has_header") & F.col("has_brand")
    return (
        products.filter(good)
        .select("brand", "product", "size", "discount_price", "retail_price", "url")
        .distinct()
    )


def rejected_pages(products: DataFrame, lenient: bool = False) -> DataFrame:
    """Pages that gave no row, with the reason."""
    reason = F.when(~F.col("has_header"), "no header")
    if not lenient:
        reason = reason.when(~F.col("has_brand"), "no brand")
    return products.select("url", reason.alias("reason")).filter(F.col("reason").isNotNull())


