"""Row-quality rules on requests.

A request row carries its symbols as an array, so every rule is a row expression: no shuffle, and
a large request costs only its own row. Each rule yields an array of ``(code, field, message)``
details, empty when the rule holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodwire import schemas
from moodwire.functions.binding import computed_once, let, unrolled
from moodwire.functions.text import byte_len, uni_upper, utrim
from moodwire.params import (
    MAX_ARTICLES,
    MAX_LOOKBACK_HOURS,
    MAX_NAME_BYTES,
    MAX_SYMBOLS,
    MAX_TICKER_BYTES,
    MIN_ARTICLES,
    MIN_LOOKBACK_HOURS,
)

# Detail messages by code.
MESSAGES = {
    "INVALID_SYMBOL_COUNT": f"symbols must contain between 1 and {MAX_SYMBOLS} items",
    "INVALID_TICKER": f"ticker must be between 1 and {MAX_TICKER_BYTES} characters",
    "INVALID_SYMBOL_NAME": f"name must be between 1 and {MAX_NAME_BYTES} characters",
    "DUPLICATE_SYMBOL": "duplicate ticker detected in request",
    "INVALID_LOOKBACK_HOURS": (
        f"lookback_hours must be between {MIN_LOOKBACK_HOURS} and {MAX_LOOKBACK_HOURS}"
    ),
    "INVALID_MAX_ARTICLES": (
        f"max_articles_per_symbol must be between {MIN_ARTICLES} and {MAX_ARTICLES}"
    ),
}


def _detail(code: str, field: Column) -> Column:
    return F.struct(
        F.lit(code).alias("code"), field.alias("field"), F.lit(MESSAGES[code]).alias("message")
    )


def _none() -> Column:
    return F.array().cast(f"array<{schemas.ERROR_DETAIL}>")


def _when(bad: Column, code: str, field: str) -> Column:
    return F.when(bad, F.array(_detail(code, F.lit(field)))).otherwise(_none())


def rule_symbol_count(symbols: Column) -> Column:
    bad = ~F.coalesce(F.size(symbols).between(1, MAX_SYMBOLS), F.lit(False))
    return _when(bad, "INVALID_SYMBOL_COUNT", "symbols")


def _bad_length(text: Column, limit: int) -> Column:
    return ~F.coalesce(byte_len(utrim(text)).between(1, limit), F.lit(False))


def _repeated(symbols: Column) -> Column:
    """Positions whose folded ticker stands earlier in the request already.

    Sorting the keys puts repeats next to each other, which keeps long requests off a quadratic
    search.
    """
    keys = F.sort_array(
        F.transform(
            symbols,
            lambda s, i: F.struct(uni_upper(utrim(s["ticker"])).alias("key"), i.alias("at")),
        )
    )
    marked = let(
        keys,
        lambda k: F.transform(
            k,
            lambda x, j: F.struct(
                x["at"].alias("at"),
                F.coalesce(
                    (x["key"] != "") & (F.get(k, j - 1)["key"] == x["key"]), F.lit(False)
                ).alias("repeated"),
            ),
        ),
    )
    return F.transform(F.sort_array(marked), lambda m: m["repeated"])


def _symbol_rule(symbols: Column, bad, code: str, part: str) -> Column:
    found = F.transform(
        symbols,
        lambda s, i: F.when(
            bad(s, i),
            _detail(code, F.concat(F.lit("symbols["), i.cast("string"), F.lit(f"].{part}"))),
        ),
    )
    return F.array_compact(found)


def rule_ticker(symbols: Column) -> Column:
    return _symbol_rule(
        symbols, lambda s, i: _bad_length(s["ticker"], MAX_TICKER_BYTES), "INVALID_TICKER", "ticker"
    )


def rule_name(symbols: Column) -> Column:
    return _symbol_rule(
        symbols, lambda s, i: _bad_length(s["name"], MAX_NAME_BYTES), "INVALID_SYMBOL_NAME", "name"
    )


def rule_duplicate(symbols: Column) -> Column:
    return let(
        _repeated(symbols),
        lambda repeated: _symbol_rule(
            symbols, lambda s, i: F.get(repeated, i), "DUPLICATE_SYMBOL", "ticker"
        ),
    )


def rule_lookback(hours: Column) -> Column:
    bad = ~F.coalesce(hours.between(MIN_LOOKBACK_HOURS, MAX_LOOKBACK_HOURS), F.lit(False))
    return _when(bad, "INVALID_LOOKBACK_HOURS", "lookback_hours")


def rule_articles(limit: Column) -> Column:
    bad = ~F.coalesce(limit.between(MIN_ARTICLES, MAX_ARTICLES), F.lit(False))
    return _when(bad, "INVALID_MAX_ARTICLES", "max_articles_per_symbol")


def symbol_details(symbols: Column) -> Column:
    """Ticker, name and duplicate findings, symbol by symbol."""

    def place(i: Column, part: str) -> Column:
        return F.concat(F.lit("symbols["), i.cast("string"), F.lit(f"].{part}"))

    def findings(s: Column, i: Column, repeated: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(
                    _bad_length(s["ticker"], MAX_TICKER_BYTES),
                    _detail("INVALID_TICKER", place(i, "ticker")),
                ),
                F.when(
                    _bad_length(s["name"], MAX_NAME_BYTES),
                    _detail("INVALID_SYMBOL_NAME", place(i, "name")),
                ),
                F.when(F.get(repeated, i), _detail("DUPLICATE_SYMBOL", place(i, "ticker"))),
            )
        )

    return let(
        _repeated(symbols),
        lambda repeated: F.flatten(
            F.transform(symbols, lambda s, i: findings(s, i, repeated))
        ),
    )


def _plain(text: Column, limit: int) -> Column:
    """A text that is short enough as it stands, with visible ASCII characters at both ends: trimming leaves it alone."""

    def visible(c: Column) -> Column:
        return F.ascii(c).between(33, 126)

    return visible(text) & (byte_len(text) <= limit) & visible(F.substring(text, -1, 1))


def _without_findings(symbols: Column, hours: Column, articles: Column) -> Column:
    """True only where no rule finds anything; other requests, null among them, go through the rules."""
    keys = F.transform(symbols, lambda s: uni_upper(s["ticker"]))
    return F.coalesce(
        F.size(symbols).between(1, MAX_SYMBOLS)
        & hours.between(MIN_LOOKBACK_HOURS, MAX_LOOKBACK_HOURS)
        & articles.between(MIN_ARTICLES, MAX_ARTICLES)
        & F.forall(symbols, lambda s: _plain(s["ticker"], MAX_TICKER_BYTES) & _plain(s["name"], MAX_NAME_BYTES))
        & (F.size(F.array_distinct(keys)) == F.size(symbols)),
        F.lit(False),
    )


def with_details(requests: DataFrame) -> DataFrame:
    """All findings of a request, none cut short: count, symbols, lookback, articles."""
    details = F.concat(
        rule_symbol_count(F.col("symbols")),
        F.coalesce(symbol_details(F.col("symbols")), _none()),
        rule_lookback(F.col("lookback_hours")),
        rule_articles(F.col("max_articles")),
    )
    clean = _without_findings(F.col("symbols"), F.col("lookback_hours"), F.col("max_articles"))
    return computed_once(requests, "details", F.when(clean, _none()).otherwise(details))


def symbol_findings(symbols: DataFrame) -> DataFrame:
    """The count, ticker, name and duplicate findings of symbols in long form, one row per finding.

    ``symbols`` has request_id, idx, ticker, name. No list of a request's symbols is built: repeats
    are numbered inside (request, folded ticker), so a request of any size is many small groups.
    """
    key = uni_upper(utrim(F.col("ticker")))
    nth = F.row_number().over(Window.partitionBy("request_id", key).orderBy("idx"))
    marked = symbols.withColumns({"_nth": nth, "_key": key})
    place = F.concat(F.lit("symbols["), F.col("idx").cast("string"), F.lit("]."))
    found = F.array_compact(
        F.array(
            F.when(
                _bad_length(F.col("ticker"), MAX_TICKER_BYTES),
                _detail("INVALID_TICKER", F.concat(place, F.lit("ticker"))),
            ),
            F.when(
                _bad_length(F.col("name"), MAX_NAME_BYTES),
                _detail("INVALID_SYMBOL_NAME", F.concat(place, F.lit("name"))),
            ),
            F.when(
                (F.col("_key") != "") & (F.col("_nth") > 1),
                _detail("DUPLICATE_SYMBOL", F.concat(place, F.lit("ticker"))),
            ),
        )
    )
    each = marked.select("request_id", "idx", F.explode(found).alias("d"))
    counts = symbols.groupBy("request_id").agg(F.count("*").alias("n"))
    sized = counts.filter(~F.col("n").between(1, MAX_SYMBOLS)).select(
        "request_id", F.lit(-1).alias("idx"), _detail("INVALID_SYMBOL_COUNT", F.lit("symbols")).alias("d")
    )
    return each.unionByName(sized).select("request_id", "idx", "d.*")


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Tickers are trimmed for the test only; the raw ticker flows on."""
    checked = with_details(requests)
    valid = checked.filter(F.size("details") == 0).drop("details")
    rejected = checked.filter(F.size("details") > 0).withColumn(
        "outcome_code", F.lit("INVALID_REQUEST")
    )
    return valid, rejected


def request_symbols(valid: DataFrame) -> DataFrame:
    """One row per asked symbol, at most ``MAX_SYMBOLS`` per request after validation."""
    keep = [c for c in valid.columns if c != "symbols"]
    return unrolled(valid, keep, F.col("symbols"), "idx", "s").select(
        *keep, "idx", F.col("s.ticker").alias("ticker"), F.col("s.name").alias("name")
    )
