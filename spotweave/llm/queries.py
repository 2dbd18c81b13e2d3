"""The registered queries of the subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm.common import WORD, n_bytes, n_words, table
from spotweave.session import fresh_path, materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return register


MIX_SQL = r"""
with sized as (
  select doc_id, case when source is null then '1' else '0' || source end as src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size
  from documents),
totals as (select src, sum(size)::bigint as source_size from sized group by src),
weighted as (
  select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by src) - 1) % 3 + 1] as w,
         source_size::double * 2.0::double as cap from totals),
leveled as (
  select *, cap / w as ratio, (sum(source_size) over ())::double * 1.5::double as budget,
         coalesce(sum(cap) over (order by cap / w, src rows between unbounded preceding and 1 preceding), 0) as capped,
         sum(w) over () - coalesce(sum(w) over (order by cap / w, src rows between unbounded preceding and 1 preceding), 0) as opened
  from weighted),
ending as (select max((budget - capped) / opened) as level from leveled where ratio >= (budget - capped) / opened),
targets as (select src, source_size, least(cap, coalesce(w * level, cap)) as target from leveled, ending),
placed as (
  select s.doc_id, s.size, t.source_size, t.target,
         row_number() over (partition by s.src order by s.size, md5('mix:' || coalesce(s.doc_id::varchar, '~'))) as i,
         case when t.source_size > 0 then t.target / t.source_size::double else 0.0::double end as rate,
         ('0x' || substr(md5('mix:offset:' || s.src), 1, 8))::bigint / 4294967296.0::double as start
  from sized s join targets t on s.src = t.src)
select doc_id, size::bigint as size, source_size, target,
       (size * (floor(rate * i + start) - floor(rate * (i - 1) + start)))::bigint as taken
from placed
"""


@query(MIX_SQL)
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, sources to target weights."""
    from spotweave.llm.mixing import mix

    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("words")), "op4-sizes")
    return mix(sized, size=F.col("words")).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


@query()
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of equal row counts, equal texts together."""
    from spotweave.llm.sharding import shard

    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    slim = docs.select(
        "doc_id",
        (n_bytes(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("same_text"),
    )
    out = shard(materialize(slim, "op8-slim"), F.col("same_text"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body)::bigint as payload_bytes, sha256(body) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when f.first is null or f.first = d.page_id then 'response' else 'revisit' end as record_type,
       case when f.first <> d.page_id then f.first end as refers_to
from d left join f on d.payload_digest = f.payload_digest and d.payload_bytes >= 100
"""


@query(WARC_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, then read every record back by its byte range."""
    from spotweave.llm.warc import read_records, write_archives

    folder = fresh_path(spark, "op1-warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests."""
    import public_tokenizers

    from spotweave.llm.byte_bpe import RANKS_FILE, decode, encode, read_ranks

    ranks = read_ranks(public_tokenizers.path(RANKS_FILE))
    return decode(encode(docs, ranks), ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text and decode the ids."""
    return bpe_digests(table(spark, sf_dir, "documents"))


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    import public_tokenizers

    from spotweave.llm.token_count import VOCABULARY_FILE, count_tokens, read_vocabulary

    vocabulary = read_vocabulary(public_tokenizers.path(VOCABULARY_FILE))
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary).withColumn("over_limit", F.col("n_tokens") > 512)


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labels that are not held out."""
    from spotweave.llm.toxicity import THRESHOLD, fit_from_labels, held_out, score

    docs = table(spark, sf_dir, "documents")
    model = fit_from_labels(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, carried=["doc_id"]).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


@query()
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows that are not held out."""
    from spotweave.llm.language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model, carried=["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


@query()
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    from spotweave.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-equal embeddings."""
    from spotweave.llm.nn_descent import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest inner products of every twentieth embedding."""
    from spotweave.llm.projected_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

URL_SQL = r"""
with recursive raw as (
  select page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') as h,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path,
         regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>', ' ', 'g') as seen
  from pages),
page as (
  select *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from raw),
named as (
  select page_id, url, path, replace(regexp_extract(unnest(regexp_extract_all(seen,
    '(?is)<link[ \t\r\n\f][^>]*rel[ \t\r\n\f]*=[ \t\r\n\f]*[\x22'']?canonical[\x22'' \t\r\n\f/>][^>]*>?')),
    '(?is)href[ \t\r\n\f]*=[ \t\r\n\f]*[\x22'']?([^\x22''> \t\r\n\f]+)', 1), '&amp;', '&') as t from page
  union all
  select page_id, url, path, replace(regexp_extract(unnest(regexp_extract_all(seen,
    '(?is)<meta[ \t\r\n\f][^>]*http-equiv[ \t\r\n\f]*=[ \t\r\n\f]*[\x22'']?refresh[\x22'' \t\r\n\f/>][^>]*>?')),
    '(?is)url[ \t\r\n\f]*=[ \t\r\n\f]*[\x22'']?([^\x22''> \t\r\n\f]+)', 1), '&amp;', '&') as t from page),
target as (
  select url as base, case
    when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t
    when starts_with(t, '//') then regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t
    when starts_with(t, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t
    when starts_with(t, '?') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || path || t
    when starts_with(t, '#') then url
    when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
    else regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)
         || case when regexp_extract(path, '(?s)^(.*/)', 1) = '' then '/' else regexp_extract(path, '(?s)^(.*/)', 1) end || t
    end as goal
  from named where t <> '' and instr(url, '://') > 0),
address as (select url as u from page union select goal from target),
node as (
  select u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) as rest
  from address where instr(u, '://') > 0),
keyed as (select *, host || case when starts_with(rest, '/') then rest else '/' || rest end as k from node),
rule(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fitting as (
  select u, rh || rp as rule, v,
         row_number() over (partition by u order by length(rh || rp) desc, length(rh) desc, v) as place
  from keyed join rule on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)),
judged as (select keyed.u, k, rule, v from keyed left join fitting on fitting.u = keyed.u and place = 1),
link as (
  select a.k as a, b.k as b from target join keyed a on a.u = base join keyed b on b.u = goal
  union select b.k, a.k from target join keyed a on a.u = base join keyed b on b.u = goal),
shut(k) as (select k from judged where v = 'block' union select b from shut join link on a = k)
select page_id, host, path, rule,
       coalesce(v, case when k in (select k from shut) then 'block' else 'allow' end) as verdict
from page left join judged on judged.u = page.url
"""


@query(URL_SQL)
def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, and by blocked URLs it is equivalent to."""
    from spotweave.llm.url_filter import judge, rules_table

    judged = judge(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES), carried=["page_id"])
    return judged.select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
    )


@query()
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every whole text, a tenth of them made periodic from some word on."""
    from spotweave.llm.runs import find_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n, g = F.size("_words").cast("long"), F.floor(F.col("_h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    word = lambda i: F.element_at("_words", (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))
    altered = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    chosen = F.col("_h") % 10 == 0
    docs = docs.withColumn("_h", h).withColumn("_words", F.when(chosen, words))  # a null doc_id leaves the text as it is
    docs = docs.select("doc_id", F.when(chosen & (n > 0), altered).otherwise(F.col("text")).alias("text"))
    found = find_runs(docs, ["doc_id"])
    runs = F.col("_runs")
    lines = F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    # greatest length / period, compared exactly by cross products
    better = lambda x, y: (y["length"] * x["period"] > x["length"] * y["period"]) | (
        (y["length"] * x["period"] == x["length"] * y["period"])
        & ((y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["period"] < x["period"])))
    )
    top = F.aggregate(runs, runs[0], lambda x, y: F.when(better(x, y), y).otherwise(x))
    found = found.withColumn("_top", F.when(F.size(runs) > 0, top))
    return found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("_top.start").alias("start"),
        F.col("_top.length").alias("length"),
        F.col("_top.period").alias("period"),
        F.floor(1000 * F.col("_top.length") / F.col("_top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


NEGATIVES_SQL = """
with q as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
score as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as s
  from q a join q b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positive as (
  select anchor_id, other as positive_id, s as positive_score from score where same
  qualify row_number() over (partition by anchor_id order by s desc, other) <= 5)
select p.anchor_id, p.positive_id,
       row_number() over (partition by p.anchor_id, p.positive_id order by s desc, other)::int as rank,
       other as negative_id, positive_score, s as negative_score
from positive p join score n on n.anchor_id = p.anchor_id and not same
     and 50 * positive_score <= 100 * s and 100 * s <= 95 * positive_score
qualify rank <= 3
"""


@query(NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, some labels moved on by one."""
    from spotweave.llm.hard_negatives import hard_negatives

    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, vec_id, F.col("embedding"), moved)
