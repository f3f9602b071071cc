"""Posts to lines, fragments, request batches and listings.

A post is one row and stays one until its parts are final: the parts of a body
are handled as an array and only then exploded. Positions and ranks inside a
post therefore need no shuffle and no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewake.functions import text as X
from pricewake.functions.brands import ALIASES, BRANDS, LINE_BRANDS

# --- fixed values ---
LINES_PER_REQUEST = 10
SOURCE = "reddit"
CHANNEL = "fragranceswap"
# --- end of fixed values ---

REPLY_SCHEMA = (
    "array<struct<author: string, flair: string, brand: string, frag_name: string, "
    "size_ml: string, price_usd: string, fill_percent: string, status: string, "
    "raw_text: string, size: string, price: string>>"
)
NUMBERS = ("size_ml", "price_usd", "fill_percent", "size", "price")
ITEM_FIELDS = (
    "author", "flair", "brand", "frag_name", "size_ml", "price_usd", "fill_percent", "status",
    "raw_text", "size", "price",
)

ITEMS = (
    "array<struct<raw_text: string, brand: string, frag_name: string, size_ml: double, "
    "price_usd: double, fill_percent: double, status: string>>"
)


def sale_posts(posts: DataFrame, mode: str = "strict") -> DataFrame:
    return posts.filter(X.is_sale_post(F.col("title"), mode))


def post_lines(posts: DataFrame, *keep: str) -> DataFrame:
    """One row per non-blank line, with its position in the post."""
    return posts.select(*keep, F.posexplode(X.lines(F.col("body"))).alias("line_no", "line"))


def post_fragments(posts: DataFrame, *keep: str) -> DataFrame:
    """One row per fragment, with the line it came from."""
    by_line = post_lines(posts, *keep)
    return by_line.select(
        *keep,
        "line_no",
        "line",
        F.posexplode(X.fragments(F.col("line"))).alias("fragment_no", "fragment"),
    )


def _kept_lines(body: Column, brands: Sequence[str]) -> Column:
    plain = F.transform(X.lines(body), X.without_emoji)
    return F.filter(plain, lambda x: X.is_informative(x, brands))


def informative_lines(
    posts: DataFrame, *keep: str, brands: Sequence[str] = LINE_BRANDS
) -> DataFrame:
    """Lines worth extracting, emoji removed, with whether they are struck out."""
    return posts.select(
        *keep, F.posexplode(_kept_lines(F.col("body"), brands)).alias("line_no", "line")
    ).withColumn("struck", X.is_struck(F.col("line")))


def line_batches(
    posts: DataFrame,
    *keep: str,
    size: int = LINES_PER_REQUEST,
    brands: Sequence[str] = LINE_BRANDS,
) -> DataFrame:
    """Informative lines of each post in consecutive chunks, joined by line breaks."""
    kept = posts.select(*keep, _kept_lines(F.col("body"), brands).alias("_lines"))
    count = F.size("_lines")
    starts = F.when(count > 0, F.sequence(F.lit(1), count, F.lit(size)))
    chunks = F.transform(starts, lambda at: F.slice("_lines", at, F.lit(size)))
    return (
        kept.select(*keep, F.posexplode(chunks).alias("batch", "lines"))
        .select(
            *keep,
            "batch",
            F.size("lines").alias("line_count"),
            F.array_join("lines", "\n").alias("text"),
        )
    )


# ---- external extraction: requests out, replies in -------------------------


def post_texts(posts: DataFrame) -> DataFrame:
    """A whole post as the text of one request."""
    return posts.withColumn("text", F.concat_ws("\n", "title", "body"))


def fragment_texts(posts: DataFrame, *keep: str, dim=None) -> DataFrame:
    """Each fragment as the text of one request, its brand found and taken out."""
    found = post_fragments(posts, *keep).withColumn(
        "_alias", X.alias_of(F.lower("fragment"), dim)
    )
    return found.select(
        *keep,
        "line_no",
        "fragment_no",
        F.col("_alias.canonical").alias("brand"),
        X.without_alias(F.col("fragment"), F.col("_alias.alias")).alias("text"),
    )


def extraction_requests(batches: DataFrame, aliases=ALIASES, brands=BRANDS) -> DataFrame:
    """A request text per batch (columns ``author, flair, text``) for an extractor."""
    names = ", ".join(dict.fromkeys([c for _, c in aliases] + list(brands)))
    request = F.concat(
        F.lit("List every item offered for sale in the lines below.\n"),
        F.lit("Answer with one JSON array and nothing else, one object per item, with the keys\n"),
        F.lit("author, flair, brand, frag_name, size (ml), price (USD), fill_percent (0-100), "),
        F.lit("status (SOLD, AVAILABLE, LISTED or null). Unknown values are null.\n"),
        F.lit("Text between ~~ and ~~ is SOLD. Skip links, emoji and remarks.\n"),
        F.lit(f"Known brands: {names}\n"),
        F.lit("author: "),
        F.coalesce(F.to_json(F.struct("author")), F.lit("")),
        F.lit("\nflair: "),
        F.coalesce(F.to_json(F.struct("flair")), F.lit("")),
        F.lit("\nlines:\n"),
        F.col("text"),
    )
    return batches.withColumn("request", request)


def reply_number(value: Column) -> Column:
    """A number as a reply may write it: bare, quoted, with a dollar sign or commas."""
    return X.number(F.regexp_replace(X.strip(value), r"^\$\s*|,(?=[0-9]{3})", ""))


def _raw_items(reply: Column, single: bool) -> Column:
    """The items of a reply with numbers as text; null for a bad reply."""
    whole = X.strip(reply)
    inner = F.regexp_extract(whole, r"(?s)(\[.*\]|\{.*\})", 1)
    doc = X.strip(F.when(F.try_parse_json(whole).isNotNull(), whole).otherwise(inner))
    array = doc
    if single:
        array = F.when(F.startswith(doc, F.lit("{")), F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc)
    usable = F.startswith(array, F.lit("[")) & F.try_parse_json(doc).isNotNull()
    return F.when(usable, F.from_json(array, REPLY_SCHEMA))


def parse_replies(
    replies: DataFrame, *keep: str, reply: str = "reply", single: bool = False
) -> DataFrame:
    """Read the JSON array in each reply; adds ``items``, null for a bad reply.

    A reply that is not JSON as a whole may still hold an array inside other
    words; the widest bracketed part is tried then. ``single`` also takes one
    bare object, the answer to a request of one fragment. Numbers may be quoted.
    """
    typed = F.transform(
        "_items",
        lambda i: F.struct(
            *[
                (reply_number(i[c]) if c in NUMBERS else i[c]).alias(c)
                for c in ITEM_FIELDS
            ]
        ),
    )
    # An element that is no object spoils the array.
    return replies.select(*keep, reply, _raw_items(F.col(reply), single).alias("_items")).select(
        *keep,
        reply,
        F.when(~F.exists("_items", lambda x: x.isNull()), typed).alias("items"),
    )


def rejected_values(
    replies: DataFrame, *keep: str, reply: str = "reply", single: bool = False
) -> DataFrame:
    """Values of good replies that should be numbers and are not: ``item_no, field, value``.

    Their fields are null in the listings.
    """
    raw = replies.select(*keep, _raw_items(F.col(reply), single).alias("_items"))
    item = F.col("_item")
    values = [F.struct(F.lit(c).alias("field"), item[c].alias("value")) for c in NUMBERS]
    return (
        raw.filter(~F.exists("_items", lambda x: x.isNull()))
        .select(*keep, F.posexplode("_items").alias("item_no", "_item"))
        .select(*keep, "item_no", F.inline(F.array(*values)))
        .filter(F.col("value").isNotNull() & reply_number(F.col("value")).isNull())
    )


def reply_listings(
    replies: DataFrame, *keep: str, reply: str = "reply", single: bool = False
) -> DataFrame:
    """One row per extracted item, numbered from 0 inside its reply."""
    parsed = parse_replies(replies, *keep, reply=reply, single=single)
    item = F.col("item")
    # Outer, then filtered: a plain explode of a column makes the optimizer test
    # its size in a filter below, where the column is worked out a second time.
    rows = parsed.select(*keep, F.posexplode_outer("items").alias("item_no", "item"))
    return rows.filter(F.col("item_no").isNotNull()).select(
        *keep,
        "item_no",
        *[item[c].alias(c) for c in ("author", "flair", "brand", "frag_name")],
        F.coalesce(item["size_ml"], item["size"]).alias("size_ml"),
        F.coalesce(item["price_usd"], item["price"]).alias("price_usd"),
        item["fill_percent"].alias("fill_percent"),
        item["status"].alias("status"),
        item["raw_text"].alias("raw_text"),
    )


def reply_items(
    posts: DataFrame, replies: DataFrame, mode: str = "any", single: bool = False
) -> DataFrame:
    """Posts with ``items`` taken from extractor replies (``url, reply`` and maybe ``batch``).

    Several replies of one post follow each other by ``batch``; a bad reply
    gives nothing, and of several good ones to one request one counts. A source line that is struck out makes its item SOLD.
    """
    if "batch" not in replies.columns:
        replies = replies.withColumn("batch", F.lit(0))
    item = F.transform(
        "items",
        lambda i: F.struct(
            i["raw_text"].alias("raw_text"),
            i["brand"].alias("brand"),
            i["frag_name"].alias("frag_name"),
            F.coalesce(i["size_ml"], i["size"]).alias("size_ml"),
            F.coalesce(i["price_usd"], i["price"]).alias("price_usd"),
            i["fill_percent"].alias("fill_percent"),
            F.when(X.is_struck(i["raw_text"]), F.lit("SOLD"))
            .otherwise(i["status"])
            .alias("status"),
        ),
    )
    # The batches of one post: as many as its text has chunks of lines.
    found = (
        parse_replies(replies, "url", "batch", single=single)
        .filter(F.col("items").isNotNull())
        .groupBy("url", "batch")
        .agg(F.min("items").alias("items"))
        .groupBy("url")
        .agg(F.array_sort(F.collect_list(F.struct("batch", item.alias("items")))).alias("_replies"))
        .select("url", F.flatten(F.col("_replies.items")).alias("_items"))
    )
    wanted = X.is_sale_post(F.col("title"), mode) & F.col("_items").isNotNull()
    return (
        posts.join(found, "url", "left")
        .withColumn("items", F.when(wanted, F.col("_items")).otherwise(F.array().cast(ITEMS)))
        .select(*posts.columns, "items")
    )


def rejected_replies(
    replies: DataFrame, *keep: str, reply: str = "reply", single: bool = False
) -> DataFrame:
    parsed = parse_replies(replies, *keep, reply=reply, single=single)
    return parsed.filter(F.col("items").isNull()).select(*keep, reply)


# ---- rule-based extraction --------------------------------------------------


def _listing_array(body: Column, brands: Sequence[str], strike_sold: bool, word_bound) -> Column:
    """All listings of one body, in order, as an array of structs."""
    pieces = F.flatten(
        F.transform(
            X.lines(body),
            lambda line: F.transform(
                X.fragments(line),
                lambda f: F.struct(
                    f.alias("text"), F.lower(f).alias("low"), X.is_struck(line).alias("struck")
                ),
            ),
        )
    )

    def measured(p: Column) -> Column:
        return F.struct(
            p["text"].alias("text"),
            p["low"].alias("low"),
            p["struck"].alias("struck"),
            X.size_ml(p["text"]).alias("size_ml"),
            X.price_usd(p["text"]).alias("price_usd"),
        )

    def branded(p: Column) -> Column:
        return F.struct(
            p["text"].alias("text"),
            p["struck"].alias("struck"),
            p["size_ml"].alias("size_ml"),
            p["price_usd"].alias("price_usd"),
            X.brand_of(p["low"], brands, word_bound).alias("brand"),
        )

    def finished(p: Column) -> Column:
        status = X.status_of(p["text"])
        if strike_sold:
            status = F.when(p["struck"], F.lit("SOLD")).otherwise(status)
        name = X.clean_item_name(X.without_brand(p["text"], p["brand"]))
        return F.struct(
            p["text"].alias("raw_text"),
            p["brand"].alias("brand"),
            name.alias("frag_name"),
            p["size_ml"].alias("size_ml"),
            p["price_usd"].alias("price_usd"),
            X.fill_percent(p["text"], p["size_ml"]).alias("fill_percent"),
            status.alias("status"),
        )

    # Brand and name are worked out for kept fragments only, each value once.
    worth = F.filter(
        F.transform(pieces, measured), lambda p: X.is_listing(p["price_usd"], p["size_ml"])
    )
    return F.transform(F.transform(worth, branded), finished)


def post_listings(
    posts: DataFrame,
    mode: str = "strict",
    brands: Sequence[str] = BRANDS,
    strike_sold: bool = True,
    word_bound: bool = False,
) -> DataFrame:
    """Posts with ``items``: their listings as an array (empty for other posts).

    ``strike_sold`` marks every listing of a struck-out line SOLD.
    ``word_bound`` finds a brand as whole words only, not inside a longer word.
    """
    items = _listing_array(F.col("body"), brands, strike_sold, word_bound)
    wanted = X.is_sale_post(F.col("title"), mode)
    none = F.array().cast(ITEMS)
    return posts.withColumn("items", F.when(wanted, items).otherwise(none))


def attach_post(with_items: DataFrame, *extra: str) -> DataFrame:
    """One row per listing with its key, the fields of its post and ``extra`` item fields."""
    item = ("brand", "frag_name", "size_ml", "price_usd", "fill_percent", "status", "raw_text")
    # Outer for the reason given in reply_listings.
    exploded = with_items.filter(X.blank_to_null(F.col("url")).isNotNull()).select(
        "author",
        "flair",
        F.posexplode_outer("items").alias("_pos", "_item"),
        F.col("url").alias("post_url"),
        F.col("title").alias("post_title"),
        F.col("date").alias("post_date"),
    )
    return exploded.filter(F.col("_pos").isNotNull()).select(
        "author",
        "flair",
        *[F.col(f"_item.{c}") for c in item],
        "post_url",
        "post_title",
        "post_date",
        F.concat_ws("#", "post_url", "_pos").alias("listing_key"),
        *[F.col(f"_item.{c}") for c in extra],
    )


def extract_listings(posts: DataFrame, **options) -> DataFrame:
    return attach_post(post_listings(posts, **options))
