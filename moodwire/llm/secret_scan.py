"""Secret scan with corpus-wide ownership: who else has this value?

Base kinds, leftmost and non-overlapping in a whole text, offsets in code points, ends exclusive:
``assign`` (a named value of 8 characters or more; the span is the whole match), ``access`` and
``hex``. A fourth kind, ``token``, is a run of 24 or more letters, digits, _ and - with both cases
and four digits, outside of all base spans. Values are hashed; distinct owners and repositories are
counted per hash over the whole corpus (a repository belongs to its owner). A value of at most ``owners``
owners and at most ``repositories`` repositories is owner-specific and looks live; one that more of
either hold is a widely copied example. Spans carry that mark and both counts. Base spans are always
reported; tokens only where they look live.

Everything is column expressions, aggregates and joins. Texts never shuffle: spans are found in the scan,
rows are landed, and only spans (joined by hash) and rows that have some (joined by file and row
number) move. A hash in a third of all rows is reduced to distinct (hash, repository) before it is
counted; its join back is an ordinary skewed join.

Defined cases: a null text is empty and has no spans. A null owner or repository counts as one of
its own. Repeated rows each report their spans. Ties (equal start) are ordered as the kinds above.
Extra columns are kept; one named like ``into`` is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import landed

NAMED = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, group of the value, least characters of the value.
KINDS = [
    ("assign", f"(?i){NAMED}", 2, 8),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
    ("token", "[A-Za-z0-9_-]{24,}", 0, 24),
]
BASE = 3
SPAN = "struct<start: int, rank: int, end: int, kind: string, value_start: int, hash: string>"


def spans_of(text: Column, rank: int) -> Column:
    """All spans of one kind: offsets are the lengths of what stands between the matches, added up."""
    kind, pattern, group, least = KINDS[rank]
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.arrays_zip(
        F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("match"), values.alias("value")
    )
    empty = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["match"])
        span = F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            (end - F.char_length(x["value"])).alias("value_start"),
            F.sha2(x["value"], 256).alias("hash"),
        )
        good = F.char_length(x["value"]) >= least
        if rank >= BASE:
            for need in ("[a-z]", "[A-Z]", "(?:[0-9][^0-9]*){4}"):
                good &= x["value"].rlike(need)
        kept = F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    found = F.aggregate(steps, start, step, lambda s: s["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def scan(
    docs: DataFrame,
    *,
    text: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    owners: int = 2,
    repositories: int | None = 100,
    into: str = "secrets",
) -> DataFrame:
    """``docs`` with ``into``: array of (start, rank, end, kind, value_start, live, owners, repositories),
    by start and kind. ``owners``, ``repositories``: the most that a live value has; None: no limit."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c != into]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    read = docs.select(
        row.alias("row"),
        F.coalesce(owner.cast("string"), F.lit("\0")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("\0")).alias("repository"),
        F.concat(*[spans_of(value, k) for k in range(BASE)]).alias("base"),
        spans_of(value, BASE).alias("tokens"),
    )
    free = F.filter(
        "tokens",
        lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])),
    )
    rows = landed(
        read.select("row", "owner", "repository", F.concat("base", free).alias("found")), "secrets"
    ).select(
        "*",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("number"),
    )
    some = rows.where(F.size("found") > 0)
    spans = some.select("file", "number", "owner", "repository", F.explode("found").alias("span"))
    held = spans.groupBy(F.col("span.hash").alias("hash"), "owner", "repository").agg(F.count("*"))
    spread = held.groupBy("hash").agg(
        F.count_distinct("owner").alias("owners"), F.count("*").alias("repositories")
    )
    judged = spans.select("file", "number", "span", F.col("span.hash").alias("hash")).join(spread, "hash")
    live = F.col("owners") <= owners
    if repositories is not None:
        live &= F.col("repositories") <= repositories
    judged = judged.where((F.col("span.rank") < BASE) | live).groupBy("file", "number").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    *[F.col(f"span.{c}") for c in ("start", "rank", "end", "kind", "value_start")],
                    live.alias("live"),
                    "owners",
                    "repositories",
                )
            )
        ).alias("spans")
    )
    kind = "start: int, rank: int, end: int, kind: string, value_start: int, live: boolean"
    none = F.array().cast(f"array<struct<{kind}, owners: bigint, repositories: bigint>>")
    with_spans = some.select("row", "file", "number").join(judged, ["file", "number"], "left")
    without = rows.where(F.size("found") == 0).select("row.*", none.alias(into))
    return with_spans.select("row.*", F.coalesce("spans", none).alias(into)).unionByName(without)


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(
        ",",
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
    )


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < BASE)


def redacted(
    text: Column, spans: Column, mark: str = "[SECRET]", example: str | None = None
) -> Column:
    """``text`` with the value of every span replaced by ``mark``; overlapping values become one.

    ``example``: what stands for values of which none looks live, ``mark`` by default.
    """
    begin = F.struct(
        F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(None).cast("boolean").alias("live")
    )
    # By value, since a named value can begin inside or before another kind's span.
    values = F.sort_array(
        F.transform(
            spans, lambda s: F.struct(s["value_start"].alias("a"), s["end"].alias("b"), s["live"].alias("live"))
        )
    )

    def marked(state: Column) -> Column:
        other = F.when(state["live"].isNull(), "").otherwise(mark if example is None else example)
        return F.concat(state["out"], F.when(state["live"], mark).otherwise(other))

    def step(state: Column, s: Column) -> Column:
        apart = s["a"] >= state["at"]
        gap = F.concat(marked(state), F.substring(text, state["at"] + 1, s["a"] - state["at"]))
        return F.struct(
            F.greatest(state["at"], s["b"]).alias("at"),
            F.when(apart, gap).otherwise(state["out"]).alias("out"),
            F.when(apart, s["live"]).otherwise(state["live"] | s["live"]).alias("live"),
        )

    rest = F.aggregate(
        values,
        begin,
        step,
        lambda s: F.concat(marked(s), F.substring(text, s["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)
