"""The dealt operators as queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

from moodwire.functions.binding import let

from .byte_bpe import ByteBPE
from .chat import formatted, linear, parsed, under_mask
from .common import shared_path
from .decontaminate import benchmark_overlap
from .filter_audit import filter_audit
from .html_text import extract
from .license_scan import TEMPLATES, templates
from .license_scan import scan as scan_licenses
from .near_dups import near_duplicates
from .periodic_runs import periodic_runs, strongest
from .quality import fit, held_out, score
from .queries import ORACLES, QUERIES, register  # noqa: F401
from .secret_scan import BASE, KINDS, base_of, scan, spelled
from .token_counts import TokenCounts
from .top_k import top_k
from .warc import page_of, read_records, write_archives

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPS_SQL = rf"""
with recursive words as (
  select doc_id, list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end s
  from words),
items as (select doc_id, unnest(s) g from sets),
shared as (
  select a.doc_id x, b.doc_id y, count(*) n from items a join items b on a.g = b.g and a.doc_id <> b.doc_id
  group by 1, 2),
links as (
  select x, y from shared join sets a on a.doc_id = x join sets b on b.doc_id = y
  where 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x, min(y) y from reach group by x)
select doc_id, len(s)::bigint n_shingles, least(doc_id, coalesce(y, doc_id)) component_id,
  doc_id <= coalesce(y, doc_id) kept
from sets left join least on x = doc_id
"""


@register("op8_near_duplicates", NEAR_DUPS_SQL)
def op8(spark, table):
    return near_duplicates(table("documents"))


OVERLAP_SQL = rf"""
with doc_words as (
  select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
item_words as (
  select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i+9], ' ') g
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) i from item_words where len(w) > 0)),
lengths as (select distinct n from windows),
grams as (
  select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from doc_words, lengths where len(w) >= n)),
hits as (select doc_id, i, grams.n, item_id from grams join windows on grams.n = windows.n and grams.g = windows.g),
hit_words as (select distinct doc_id, unnest(range(i, i + n)) k from hits),
hit_counts as (select doc_id, count(*) n_hit from hit_words group by 1),
found as (
  select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids
  from (select distinct doc_id, item_id from hits) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc_words d left join hit_counts h on h.doc_id = d.doc_id left join found f on f.doc_id = d.doc_id
"""


@register("op4_benchmark_overlap", OVERLAP_SQL)
def op4(spark, table):
    found = benchmark_overlap(table("documents").select("doc_id", "text"), table("benchmark"))
    return found.select(
        "doc_id",
        "overlap.n_words",
        "overlap.n_hit",
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "overlap.items"), 256).alias("items_sha256"),
        (F.col("overlap.n_hit") > 0).alias("contaminated"),
    )


@register("op7_byte_bpe")
def op7(spark, table):
    coder = ByteBPE(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = table("documents").select("doc_id", F.col("text").alias("value"))
    return coder.encode(texts, "value", "ids", back="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op6_quality")
def op6(spark, table):
    docs = table("documents").select("doc_id", "text")
    model = fit(docs, table("labels"), label="quality")
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


SECRETS_SQL = r"""
with docs as (select doc_id, source, lang, coalesce(text, '') t from documents),
assign as (
  select doc_id, source, 0 rank, 'assign' kind, string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') p,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) m,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) v,
    8 least from docs
  union all select doc_id, source, 1, 'access', string_split_regex(t, 'AKIA[A-Z0-9]+'),
    regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), 16 from docs
  union all select doc_id, source, 2, 'hex', string_split_regex(t, '[0-9a-f]{32,}'),
    regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}'), 32 from docs
  union all select doc_id, source, 3, 'token', string_split_regex(t, '[A-Za-z0-9_-]{24,}'),
    regexp_extract_all(t, '[A-Za-z0-9_-]{24,}'), regexp_extract_all(t, '[A-Za-z0-9_-]{24,}'), 24 from docs),
spans as (
  select doc_id, source, rank, kind, v[i] v, least,
    (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint a,
    length(m[i]) n
  from (select *, unnest(range(1, len(m) + 1)) i from assign where len(m) > 0)),
good as (select doc_id, source, rank, kind, v, a, a + n b from spans where length(v) >= least),
found as (
  select * from good g where rank < 3 or (
    regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '([0-9][^0-9]*){4}')
    and not exists (select 1 from good o where o.doc_id = g.doc_id and o.rank < 3 and o.a < g.b and o.b > g.a))),
spread as (select v, count(distinct coalesce(source, '')) n from found group by 1),
judged as (
  select f.*, kind || ':' || a || ':' || b s from found f join spread using (v) where rank < 3 or n <= 1),
per as (
  select doc_id, count(*) filter (rank = 0) n_assign, count(*) filter (rank = 1) n_access, count(*) filter (rank = 2) n_hex,
    string_agg(s, ',' order by a, rank) filter (rank < 3) base, string_agg(s, ',' order by a, rank) spans
  from judged group by 1)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from docs left join per using (doc_id)
"""


@register("op10_secrets", SECRETS_SQL)
def op10(spark, table):
    found = scan(table("documents"), owners=1, repositories=None)  # what its SQL counts as live
    found = found.select("doc_id", "secrets", base_of(F.col("secrets")).alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k, *_ in KINDS[:BASE]],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.col("secrets")).alias("spans"),
    )


WARC_SQL = """
with own as (
  select page_id, coalesce(html, '') html, octet_length(encode(coalesce(html, ''))) n, sha256(coalesce(html, '')) digest
  from pages),
firsts as (select digest, min(page_id) first from own where n >= 100 group by 1)
select page_id, n::bigint payload_bytes, own.digest payload_digest,
  case when n < 100 or page_id = first then 'response' else 'revisit' end record_type,
  case when n >= 100 and page_id <> first then first end refers_to
from own left join firsts on own.digest = firsts.digest
"""


@register("op5_warc", WARC_SQL)
def op5(spark, table):
    path = shared_path(spark, "archives")
    write_archives(table("pages"), path)
    return read_records(spark, path).select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )


TOP_K_SQL = """
with own as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint score
  from own q join own c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@register("op3_top_k", TOP_K_SQL)
def op3(spark, table):
    return top_k(table("embeddings"), F.col("vec_id") % 50 == 0)


CHAT_SQL = r"""
with own as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(10 + length(url_encode(role))
    + length(regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|<</?SYS>>)', '\1\\\2', 'g')))::bigint formatted_chars
from own group by conv_id
"""


@register("op2_chat", CHAT_SQL)
def op2(spark, table):
    text = F.lit("</s>[INST] ok [/INST]").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, text)
    rows = table("conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = formatted(linear(rows))
    turns, loss = parsed(F.col("formatted")), under_mask(F.col("formatted"), F.col("loss"))
    read = done.select("tree", turns.alias("turns"), loss.alias("learned"), "formatted")
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.when(F.col("tree") != "null", F.substring("tree", 2, 30).cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@register("op1_html_text")
def op1(spark, table):
    found = extract(table("pages").select("page_id", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))

LICENSE_WORDS = f"regexp_extract_all({LOWER}, '[a-z0-9]+')"
LICENSES_SQL = f"""
with templates(license, text) as (values {", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)}),
known as (
  select license, number, len(s) n, list_distinct(s) wanted, (2 ** ceil(log2(len(s))))::bigint c
  from (select license, row_number() over () number,
          list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) s
        from (select license, {LICENSE_WORDS} w from templates))),
places as (
  select doc_id, i - 1 pos, array_to_string(w[i:i+4], ' ') g
  from (select doc_id, w, unnest(range(1, len(w) - 3)) i from (select doc_id, {LICENSE_WORDS} w from documents))),
wanted as (select license, number, c, len(wanted) n, unnest(wanted) g from known),
hits as (select doc_id, pos, license, number, c, n, g from places join wanted using (g)),
shares as (
  select doc_id, license, number, w, count(distinct g) / n share
  from (select *, unnest([pos // c * c, pos // c * c - c]) w from hits) where w >= 0
  group by doc_id, license, number, n, w),
found as (
  select doc_id, license from shares group by 1, 2 having max(share) >= 0.8)
select d.doc_id, count(license)::bigint n_licenses, coalesce(string_agg(license, ',' order by license), '') licenses
from documents d left join found f on f.doc_id = d.doc_id group by d.doc_id
"""


@register("op9_licenses", LICENSES_SQL)
def op9(spark, table):
    found = scan_licenses(table("documents").select("doc_id", "text"), templates(spark))
    names = F.transform("licenses", lambda x: x["license"])
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", names).alias("licenses")
    )


@register("op11_token_counts")
def op11(spark, table):
    counts = TokenCounts(spark, public_tokenizers.path("word_bpe_49k.json"))
    found = counts.counted(table("documents").select("doc_id", "text"), limit=2048)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


FILTERS_SQL = r"""
with recursive own as (
  select doc_id, coalesce(lang, '') part, coalesce(text, '') t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
marks as (
  select doc_id, bool_or(coalesce(quality, 0) = 1) good, bool_or(coalesce(toxic, 0) = 1) toxic from labels group by 1),
judged as (
  select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
    case when len(w) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when coalesce(own.doc_id > min(own.doc_id) over (partition by t), false) then 'E' else '' end fails
  from own left join marks on own.doc_id = marks.doc_id),
counts as (
  select part, fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from judged group by 1, 2),
orders as (
  select '' o union all
  select o || f from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) x(f) where not contains(o, f)),
steps as (select o, s::integer s, o[s:s] f from (select o, unnest(range(1, 6)) s from orders where length(o) = 5)),
seen as (
  select part, o, s, f, fails, n, good, toxic, contains(fails, f) fails_here,
    exists (select 1 from (select unnest(range(1, s)) k) where contains(fails, o[k:k])) earlier
  from counts, steps),
summed as (
  select part, o filter_order, s step, f,
    sum(n) filter (not fails_here and not earlier)::bigint kept,
    sum(n) filter (fails_here and not earlier)::bigint removed,
    sum(n) filter (fails_here and earlier)::bigint redundant,
    sum(n) filter (fails = f)::bigint unique_fails,
    sum(good) filter (fails_here and not earlier)::bigint good_lost,
    sum(toxic) filter (fails_here and not earlier)::bigint toxic_lost
  from seen group by 1, 2, 3, 4)
select part, filter_order, step, coalesce(kept, 0) kept, coalesce(removed, 0) removed,
  coalesce(redundant, 0) redundant, coalesce(unique_fails, 0) unique_fails, coalesce(good_lost, 0) good_lost,
  coalesce(toxic_lost, 0) toxic_lost, coalesce(sum(removed) over (partition by part, f), 0)::bigint shapley
from summed
"""


@register("op12_filter_audit", FILTERS_SQL)
def op12(spark, table):
    return filter_audit(table("documents"), table("labels"))


def planted() -> Column:
    """The text of a document; with every tenth id hash, its end repeats a stretch of words."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    inner = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(inner, r"[\x20\x09-\x0D]+")

    def ended(w):
        n, g = F.size(w), F.floor(hashed / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        copies = F.ceil((n - a) / p).cast("int")
        end = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), copies)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), end), " ")

    return F.when((hashed % 10 == 0) & (inner != ""), let(words, ended)).otherwise(F.col("text"))


@register("op13_periodic_runs")
def op13(spark, table):
    found = periodic_runs(table("documents").select("doc_id", planted().alias("text")))
    best = F.col("best")
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
