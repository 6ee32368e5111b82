"""The registered queries of this package: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeframe.llm import (
    bag_minhash, embedding_dedup, filter_audit, language_id, mixing, multiset_fingerprint, piece_lattice, pivot_search, sharding, token_counts, url_filter,
    warc_fixity, whitening,
)
from plumeframe.llm.common import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_documents(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


BLOCK = ("com/en/", "example.net/de/8", "org/es/")
ALLOW = ("example.com/en/7", "net/de/")

SQL["op2_url_filter"] = r"""
with rules(rule, verdict) as (values ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
split as (select *, split_part(rule, '/', 1) as rule_host, substr(rule, strpos(rule, '/')) as rule_path from rules),
u as (select row_number() over () as n, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select n, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select n, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from p join split on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path) group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m using (n)"""


@query
def op2_url_filter(spark, sf_dir):
    index = url_filter.write_index(url_filter.rule_table(spark, BLOCK, ALLOW))
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), index).drop("url")


@query
def op3_bag_minhash(spark, sf_dir):
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


_USABLE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
SQL["op4_pivot_search"] = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings where {_USABLE}),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10"""


@query
def op4_pivot_search(spark, sf_dir):
    index = pivot_search.pivot_table(table(spark, sf_dir, "embeddings"))
    return pivot_search.top_k(index, F.col("vec_id") % 100 == 0, k=10)


SQL["op5_warc_fixity"] = r"""
with named as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html,
  md5(case when page_id is null then coalesce(url, '') when url is null then cast(page_id as varchar) else cast(page_id as varchar) || '|' || url end) as name from pages),
texts as (select page_id, name, html, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
  'WARC-Date: 2024-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Record-ID: <urn:uuid:',
  name[1:8], '-', name[9:12], '-', name[13:16], '-', name[17:20], '-', name[21:32], '>', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
  'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) as record from named),
measured as (select page_id, name, html, cast(strlen(record) as bigint) as record_length, sha256(record) as record_digest from texts),
filed as (select *, cast(('0x' || name[1:8])::bigint % greatest(1, cast(ceil((select sum(record_length) from measured) / 67108864.0) as bigint)) as integer) as warc_file from measured)
select page_id, warc_file, cast(coalesce(sum(record_length) over (partition by warc_file order by page_id, name, record_digest rows between unbounded preceding and 1 preceding), 0) as bigint) as record_offset,
  record_length, record_digest, case when name[31:32] = '07' and starts_with(html, '<') then 'corrupt' when name[31:32] = '08' then 'missing' else 'ok' end as status from filed"""


@query
def op5_warc_fixity(spark, sf_dir):
    """An archive of the pages against a replica in which some payloads are damaged and some records are lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    mark = F.substring(F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url")), 31, 2)
    payload = F.when((mark == "07") & F.startswith("html", F.lit("<")), F.concat(F.lit("#"), F.substring("html", F.lit(2), F.length("html")))).otherwise(F.col("html"))
    records = staged(warc_fixity.warc_records(pages), "records")
    replica = warc_fixity.warc_records(pages.withColumn("html", payload)).filter(F.substring("name", 31, 2) != "08")
    shape = warc_fixity.tree_shape(records)
    faults = warc_fixity.audit(warc_fixity.fixity_tree(records, shape), warc_fixity.fixity_tree(replica, shape), shape)
    judged = records.join(faults, ["warc_file", "record_offset"], "left")
    return judged.select(
        "page_id", "warc_file", "record_offset", "record_length", "record_digest", F.coalesce("status", F.lit("ok")).alias("status")
    )


@query
def op6_piece_lattice(spark, sf_dir):
    """Number and checksum of each document's ids, and whether decoding them gives the text back."""
    encoded = piece_lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_lattice.load_pieces())
    return encoded.select("doc_id", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


@query
def op7_token_counts(spark, sf_dir):
    """Tokens of each document, and after three edits at places that its id decides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edits = F.array(
        *[
            F.struct(
                F.pmod(F.xxhash64("doc_id", F.lit(i)), F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long").alias("start"),
                F.lit(removed).cast("long").alias("removed"),
                F.concat(F.lit(inserted), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("inserted"),
            )
            for i, (removed, inserted) in enumerate(((40, " amended "), (0, "x"), (1, " ")))
        ]
    )
    counted = token_counts.build_trees(docs).withColumnRenamed("n_tokens", "tokens_before").withColumn("edits", edits)
    edited = token_counts.apply_edits(counted.withColumn("n_tokens", F.col("tokens_before")))
    return edited.select(
        "doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), F.coalesce(F.length("text"), F.lit(0)).alias("chars_after"), "n_encoded"
    )


@query
def op8_external_shuffle(spark, sf_dir):
    sharded = sharding.shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    return mixing.with_shards(mixing.planned_documents(docs)).select("doc_id", "size", "source_size", "target", "taken", "mix_shards")


SQL["op10_embedding_dedup"] = f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where {_USABLE} and label is not null
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a, min(b) as b from reach group by a), counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(roots.b, vec_id)) as component_id,
  least(vec_id, coalesce(roots.b, vec_id)) = vec_id as kept
from embeddings left join counts on counts.a = vec_id left join roots on roots.a = vec_id"""


@query
def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_multiset_fingerprint(spark, sf_dir):
    return multiset_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), scale=256.0, components=4)


SQL["op13_filter_audit"] = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
masks as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(words) < 100 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 80 * len(words) then 'B' else '' end
    || case when 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when texts.doc_id > min(texts.doc_id) over (partition by t) then 'E' else '' end as fails
  from texts left join marks using (doc_id)),
counted as (select part, fails, count(*) as c, sum(good) as g, sum(toxic) as x from masks group by all),
letter(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (select a.l || b.l || c.l || d.l || e.l as o from letter a join letter b on b.l <> a.l join letter c on c.l not in (a.l, b.l)
  join letter d on d.l not in (a.l, b.l, c.l) join letter e on e.l not in (a.l, b.l, c.l, d.l)),
steps as (select o, s.step, substr(o, s.step, 1) as own, substr(o, 1, s.step - 1) as earlier from orders cross join (select unnest([1, 2, 3, 4, 5]) as step) s),
judged as (select part, o, step, own, strpos(fails, own) > 0 as failing, earlier <> '' and regexp_matches(fails, '[' || earlier || ']') as gone, fails = own as alone, c, g, x
  from (select o, step, own, case when earlier = '' then '-' else earlier end as earlier from steps) cross join counted),
summed as (select part, o, step, own, sum(case when not failing and not gone then c else 0 end) as kept, sum(case when failing and not gone then c else 0 end) as removed,
  sum(case when failing and gone then c else 0 end) as redundant, sum(case when alone then c else 0 end) as unique_fails,
  sum(case when failing and not gone then g else 0 end) as good_lost, sum(case when failing and not gone then x else 0 end) as toxic_lost from judged group by all)
select part, o as filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley from summed"""


@query
def op13_filter_audit(spark, sf_dir):
    return filter_audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
