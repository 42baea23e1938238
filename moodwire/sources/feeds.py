"""Decoders of the four feed shapes.

Each decoder turns payload rows into mentions ``(request_id, pos, ticker, title)`` in feed order.
Feeds 1, 2 and 4 reject a payload as a whole when any item has the wrong shape; feed 3 has a
tolerant path that skips bad items. A key that is read and comes twice makes the typed decode fail; elsewhere
repeated keys do no harm, and on the tolerant path the last one counts. Matching mentions to the requested symbols is the job of
``operators.attribution``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodwire.functions import strict_json as J
from moodwire.functions.binding import let, unrolled
from moodwire.functions.text import utrim

# Wire names in the feed bodies.
FEED1 = "array<struct<title:variant,tickers:array<variant>>>"
FEED2 = "struct<data:array<struct<title:variant,entities:array<struct<symbol:variant>>>>>"
FEED4 = "array<struct<headline:variant>>"
NOTICE_KEYS = ["Note", "Information", "Error Message"]
FEED3_ITEMS = "array<struct<title:variant,ticker_sentiment:array<struct<ticker:variant>>>>"
_NOTES = ",".join(f"`{k}`:variant" for k in NOTICE_KEYS)
NOTICES = f"struct<{_NOTES}>"
FEED3 = f"struct<feed:{FEED3_ITEMS},{_NOTES}>"
# The same shapes with nothing but texts in them.
PLAIN1 = "array<struct<title:string,tickers:array<string>>>"
PLAIN2 = "struct<data:array<struct<title:string,entities:array<struct<symbol:string>>>>>"
PLAIN3 = "struct<feed:array<struct<title:string,ticker_sentiment:array<struct<ticker:string>>>>>"
PLAIN4 = "array<struct<headline:string>>"


def _mentions(payloads: DataFrame, pairs: Column, feed_rank: int) -> DataFrame:
    """One row per (title, ticker) pair; a null list gives no row."""
    return unrolled(payloads, ["request_id"], pairs, "pos", "m").select(
        "request_id",
        F.lit(feed_rank).alias("feed_rank"),
        "pos",
        F.col("m.ticker").alias("ticker"),
        F.col("m.title").alias("title"),
    )


def title_pairs(items: Column, names: str, title: str = "title", name_of=lambda n: n) -> Column:
    return F.flatten(
        F.transform(
            items,
            lambda item: F.transform(
                item[names],
                lambda n: F.struct(
                    J.text_of(item[title]).alias("title"), J.text_of(name_of(n)).alias("ticker")
                ),
            ),
        )
    )


def plain_pairs(items: Column, names: str, name_of=lambda n: n) -> Column:
    """``title_pairs`` of items that hold texts."""
    return F.flatten(
        F.transform(
            items,
            lambda item: F.transform(
                item[names], lambda n: F.struct(item["title"].alias("title"), name_of(n).alias("ticker"))
            ),
        )
    )


def feed1_items(body: Column) -> Column:
    """Items of a well-formed feed 1 body, else null."""

    def good(item: Column) -> Column:
        return J.is_string(item["title"]) & F.coalesce(
            F.forall(item["tickers"], J.is_string), F.lit(False)
        )

    return _whole(J.parse_typed(body, FEED1, _in_items(["title", "tickers"])), good)


def _in_items(names: list[str]):
    """Whether an item of a body that is a list has one of ``names`` twice."""
    return lambda body: J.any_of(J.objects(body), lambda item: J.twice(item, names))


def _whole(items: Column, good) -> Column:
    """The list when all items are good, else null."""
    return let(items, lambda listed: F.when(F.forall(listed, good), listed))


def decode_feed1(payloads: DataFrame) -> DataFrame:
    staged = payloads.select("request_id", feed1_items(F.col("body")).alias("items"))
    return _mentions(staged, title_pairs(F.col("items"), "tickers"), 1)


def feed2_items(body: Column) -> Column:
    """Items of a well-formed feed 2 body, else null."""

    def good(item: Column) -> Column:
        return J.is_string(item["title"]) & F.coalesce(
            F.forall(item["entities"], lambda e: J.is_string(e["symbol"])), F.lit(False)
        )

    def repeats(text: Column) -> Column:
        return J.any_of(
            J.objects(J.in_brackets(text)),
            lambda root: J.twice(root, ["data"])
            | J.any_of(
                J.objects(root["data"]),
                lambda item: J.twice(item, ["title", "entities"])
                | J.any_of(J.objects(item["entities"]), lambda e: J.twice(e, ["symbol"])),
            ),
        )

    return _whole(J.parse_typed(body, FEED2, repeats)["data"], good)


def decode_feed2(payloads: DataFrame) -> DataFrame:
    staged = payloads.select("request_id", feed2_items(F.col("body")).alias("items"))
    return _mentions(
        staged, title_pairs(F.col("items"), "entities", name_of=lambda e: e["symbol"]), 2
    )


def feed3_root(body: Column) -> Column:
    """A feed 3 body as a variant, else null; of repeated keys the last one counts.

    A body that is no variant because of repeated keys is written anew from the fields that are read.
    """
    read = J.read_as(J.in_brackets(body), f"array<struct<feed:array<string>,{_NOTES}>>")

    def item(text: Column) -> Column:
        return let(
            J.read_as(text, "struct<title:variant,ticker_sentiment:array<string>>"),
            lambda i: F.struct(
                i["title"].alias("title"),
                F.transform(i["ticker_sentiment"], lambda n: J.read_as(n, "struct<ticker:variant>")).alias(
                    "ticker_sentiment"
                ),
            ),
        )

    def anew(root: Column) -> Column:
        notes = [root[k].alias(k) for k in NOTICE_KEYS]
        return F.to_json(F.struct(F.transform(root["feed"], item).alias("feed"), *notes))

    rebuilt = let(F.get(read, F.lit(0)), lambda root: F.when(root.isNotNull(), anew(root)))
    return F.coalesce(
        J.parse_variant(body), F.when(J.well_formed(body), J.parse_variant(rebuilt))
    )


def feed3_declared(body: Column, root: Column) -> Column:
    """Whether a body, parsed as ``root``, has the declared shape and no key of it twice."""
    repeats = J.any_of(
        J.objects(J.in_brackets(body)),
        lambda r: J.twice(r, ["feed", *NOTICE_KEYS])
        | J.any_of(
            J.objects(r["feed"]),
            lambda item: J.twice(item, ["title", "ticker_sentiment"])
            | J.any_of(J.objects(item["ticker_sentiment"]), lambda n: J.twice(n, ["ticker"])),
        ),
    )
    once = F.try_parse_json(J.in_brackets(body)).isNotNull() | ~repeats
    return F.coalesce(feed3_typed(root) & once, F.lit(False))


def feed3_typed(root: Column) -> Column:
    """Whether a parsed feed 3 body has the declared shape throughout.

    A body with all declared parts is known by its typed copy. A part that is null there may be absent, null or of
    another shape, so such a body is walked through.
    """

    def item_good(item: Column) -> Column:
        names = F.forall(item["ticker_sentiment"], lambda n: J.is_string(n["ticker"]))
        return J.optional_string(item["title"]) & F.coalesce(names, F.lit(False))

    def complete(parts: Column) -> Column:
        good = F.coalesce(F.forall(parts["feed"], item_good), F.lit(False))
        for key in NOTICE_KEYS:
            good = good & J.optional_string(parts[key])
        return good

    return let(
        F.try_variant_get(root, "$", FEED3), lambda parts: F.when(complete(parts), True).otherwise(_walked_feed3(root))
    )


def _walked_feed3(root: Column) -> Column:
    """``feed3_typed`` of any body, part by part."""

    def list_or_absent(value: Column, good) -> Column:
        every = F.coalesce(F.forall(J.as_array(value), good), F.lit(False))
        return value.isNull() | every

    def item_good(item: Column) -> Column:
        names = let(
            J.at(item, "$.ticker_sentiment"),
            lambda v: list_or_absent(v, lambda n: J.is_string(J.at(n, "$.ticker"))),
        )
        return J.is_object(item) & J.optional_string(J.at(item, "$.title")) & names

    good = J.is_object(root) & let(
        J.at(root, "$.feed"), lambda v: list_or_absent(v, item_good)
    )
    for key in NOTICE_KEYS:
        good = good & J.optional_string(J.at(root, f'$["{key}"]'))
    return good


def payload_notice(root: Column, typed: Column) -> Column:
    """A body that carries a notice yields nothing.

    On the typed path a null notice is no notice; on the tolerant path the key alone counts.
    """

    def carried(value: Column) -> Column:
        return value.isNotNull() & ~(F.coalesce(typed, F.lit(False)) & (J.type_of(value) == "VOID"))

    def any_carried(notes: Column) -> Column:
        found = carried(notes[NOTICE_KEYS[0]])
        for key in NOTICE_KEYS[1:]:
            found = found | carried(notes[key])
        return found

    # One struct for all keys: a path that leads nowhere is dear, and most bodies have no notice.
    return let(F.try_variant_get(root, "$", NOTICES), any_carried)


def read_feed3(payloads: DataFrame) -> DataFrame:
    """Payloads with ``root`` (parsed body or null), ``typed`` and ``notice``."""
    parsed = payloads.withColumn("root", feed3_root(F.col("body")))
    typed = parsed.withColumn("typed", feed3_declared(F.col("body"), F.col("root")))
    return typed.withColumn(
        "notice",
        F.col("root").isNotNull()
        & F.coalesce(payload_notice(F.col("root"), F.col("typed")), F.lit(False)),
    )


def feed3_pairs(root: Column) -> Column:
    """(title, ticker) pairs of the usable items.

    On a body that passes ``feed3_typed`` this equals the typed decode, so both paths share it.
    """
    items = F.transform(
        F.try_variant_get(root, "$.feed", FEED3_ITEMS),
        lambda item: F.struct(
            F.when(J.is_string(item["title"]), utrim(J.text_of(item["title"]))).alias("title"),
            item["ticker_sentiment"].alias("names"),
        ),
    )
    usable = F.filter(
        items, lambda i: F.coalesce(i["title"] != "", F.lit(False)) & i["names"].isNotNull()
    )
    return F.flatten(
        F.transform(
            usable,
            lambda i: F.transform(
                F.filter(i["names"], lambda n: J.is_string(n["ticker"])),
                lambda n: F.struct(i["title"].alias("title"), J.text_of(n["ticker"]).alias("ticker")),
            ),
        )
    )


def plain_feed3_pairs(items: Column) -> Column:
    """``feed3_pairs`` of items that hold texts."""
    trimmed = F.transform(
        items,
        lambda i: F.struct(utrim(i["title"]).alias("title"), i["ticker_sentiment"].alias("names")),
    )
    return plain_pairs(F.filter(trimmed, lambda i: i["title"] != ""), "names", name_of=lambda n: n["ticker"])


def decode_feed3(payloads: DataFrame, tolerant: bool = True) -> DataFrame:
    """Feed 3 mentions; ``tolerant=False`` keeps only bodies of the declared shape."""
    wanted = ~F.col("notice") if tolerant else ~F.col("notice") & F.col("typed")
    return _mentions(read_feed3(payloads), F.when(wanted, feed3_pairs(F.col("root"))), 3)


def decode_feed3_tolerant(payloads: DataFrame) -> DataFrame:
    """Only the bodies that the typed decode refuses."""
    wanted = ~F.col("notice") & ~F.col("typed")
    return _mentions(read_feed3(payloads), F.when(wanted, feed3_pairs(F.col("root"))), 3)


def feed3_notices(payloads: DataFrame) -> DataFrame:
    """Bodies that carry a notice; each counts as a ``2xx_payload_error`` of its feed."""
    kept = [c for c in payloads.columns if c != "body"]
    marked = F.when(F.col("notice"), F.array(F.lit(True)))
    return unrolled(read_feed3(payloads), [*kept, "typed"], marked).drop("pos", "item")


def feed4_items(body: Column) -> Column:
    """Items of a well-formed feed 4 body, else null."""
    items = J.parse_typed(body, FEED4, _in_items(["headline"]))
    return _whole(items, lambda item: J.is_string(item["headline"]))


def decode_feed4(payloads: DataFrame) -> DataFrame:
    """Feed 4 serves one ticker per payload, named by the payload row."""
    staged = payloads.select(
        "request_id", "ticker", feed4_items(F.col("body")).alias("items")
    )
    pairs = F.transform(
        F.col("items"),
        lambda item: F.struct(
            J.text_of(item["headline"]).alias("title"), F.col("ticker").alias("ticker")
        ),
    )
    return _mentions(staged, pairs, 4)
