"""The operators over the driver's tables: documents are files whose path is the doc_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packaudit.llm.common import stored
from packaudit.llm import decisions, languages, merkle, mixture, passages, pieces, prefixes, private, quality, simhash, sketches, toxicity, vectors


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))


def tokenizer(spark: SparkSession, name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    return pieces.read_model(spark, public_tokenizers.path(name))


def op1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    back = pieces.round_trip(files(spark, sf), tokenizer(spark))
    return back.select(F.col("path").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("content", 256).alias("decoded_sha256"), F.xxhash64("edges").alias("spans_xxh64"))


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("path"), F.col("quality").alias("label"))
    rated = quality.rate(files(spark, sf), labels)
    return rated.select(F.col("path").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _digest(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_private(spark: SparkSession, sf: str) -> DataFrame:
    found = private.find(files(spark, sf)).withColumn("base", F.filter("spans", lambda s: s["plain"]))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] != k), True)).cast("long").alias(f"n_{k}") for k in private.KINDS]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.classes(files(spark, sf))
    return found.select(F.col("path").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumnsRenamed({"doc_id": "path", "text": "content"})
    mixed = mixture.mix(docs, mixture.tempered(docs, "source"), "source")
    return mixed.withColumnsRenamed({"path": "doc_id", "content": "text"})


def op6_sketches(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.with_neighbours(files(spark, sf)).withColumnRenamed("path", "doc_id")


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("path"), F.col("toxic").alias("label"))
    rated = toxicity.rate(files(spark, sf), labels)
    return rated.select(F.col("path").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.links(table(spark, sf, "embeddings")).withColumnRenamed("component", "component_id")


def op9_languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"), "lang")
    return languages.identify(docs).withColumnRenamed("path", "doc_id")


def op10_passages(spark: SparkSession, sf: str) -> DataFrame:
    left = passages.dedupe(files(spark, sf))
    return left.select(F.col("path").alias("doc_id"), "n_words", "n_removed", F.sha2("content", 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    more = [F.col("n_chars") + 1 if f == "n_chars" else f for f in fields]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("skill_id"), merkle.leaf(*fields).alias("leaf"),
                                                  F.when(tampered, merkle.leaf(*more)).alias("tampered"))
    found = merkle.witnesses(leaves)
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("siblings"))
    return found.select(F.col("path").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("siblings")).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _rebuilt(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as packages whose first steps are those of the conversation at the hundred
    below, and their ids.  At most five steps of a hundred are dealt to its conversations."""
    own = items.select("skill_id", "depth", "item", "n_chars")
    sizes = items.groupBy("skill_id").agg(F.max("n_steps").alias("n_steps"))
    plan = sizes.select("skill_id", (F.crc32(F.col("skill_id").cast("string").cast("binary")) % 6).alias("taken"), (F.col("skill_id") - F.col("skill_id") % 100).alias("base"))
    plan = plan.join(sizes.select(F.col("skill_id").alias("base"), F.col("n_steps").alias("had")), "base", "left").withColumn("had", F.least("taken", F.coalesce("had", F.lit(0))))
    first = own.where("depth <= 5").withColumnRenamed("skill_id", "base")
    front = plan.select("skill_id", "base", "taken").join(first, "base").where("depth <= taken").select("skill_id", "depth", "item", "n_chars")
    back = own.join(plan, "skill_id").where("depth > taken").select("skill_id", (F.col("depth") - F.col("taken") + F.col("had")).alias("depth"), "item", "n_chars")
    return front.unionByName(back), sizes.select("skill_id")


def op12_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").where("conv_id is not null")
    steps = turns.select(F.col("conv_id").alias("skill_id"), F.col("turn").alias("step_index"), F.col("role").alias("action"), F.col("text").alias("description"))
    nodes = prefixes.trie(*_rebuilt(stored(prefixes.in_order(prefixes.items(steps)), "items")))
    return nodes.withColumnsRenamed({"skill_id": "conv_id", "parent_skill_id": "parent_conv_id", "n_skills": "n_convs", "saved_chars": "saved_tokens"})


def op13_decisions(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("path"), F.col("quality").alias("label"))
    return decisions.judge(files(spark, sf), labels).withColumnRenamed("path", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_quality": op2_quality,
    "op3_private": op3_private,
    "op4_simhash": op4_simhash,
    "op5_mixture": op5_mixture,
    "op6_sketches": op6_sketches,
    "op7_toxicity": op7_toxicity,
    "op8_vectors": op8_vectors,
    "op9_languages": op9_languages,
    "op10_passages": op10_passages,
    "op11_merkle": op11_merkle,
    "op12_prefixes": op12_prefixes,
    "op13_decisions": op13_decisions,
}


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text expression, bit by bit: -1 in the list stands for a shift."""
    return f"""xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split({text}, ''),
        lambda c: list_concat([ascii(c)::bigint], [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))),
        lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295)"""


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

ORACLE: dict[str, str] = {
    "op5_mixture": """
with recursive sizes as (select source, count(*) as n, pow(count(*)::double, 0.5) as weight from documents group by source),
rates as (select source, weight / (select sum(weight) from sizes) * (select sum(n) from sizes) * 1.0 / n as rate from sizes),
dist as (
  select source, rate, 0 as k, -rate as l, exp(-rate) as cdf from rates
  union all
  select source, rate, k + 1, l + ln(rate / (k + 1)), cdf + exp(l + ln(rate / (k + 1))) from dist where k < ceil(rate + 10 * sqrt(rate) + 20)),
cdfs as (select source, list(cdf order by k) as cdf from dist group by source),
drawn as (
  select d.*, len(list_filter(c.cdf, lambda x: x <= u)) as times
  from (select *, ('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::bigint / 4503599627370496.0 as u from documents) d
  join cdfs c on d.source is not distinct from c.source)
select doc_id, text, lang, source, n_chars, copy::int as copy, md5('mix-1:' || doc_id || ':' || copy) as mix_key
from (select *, unnest(generate_series(1, times)) as copy from drawn)""",
    "op11_merkle": f"""
with recursive raw as (
  select doc_id, lang, {_LEAF} as leaf, case when {crc32_sql("doc_id::varchar")} % 7 = 0 then {_LEAF.replace("n_chars", "(n_chars + 1)")} end as tampered from documents),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from raw),
tree as (
  select lang, 0 as level, pos, count(*) over (partition by lang) as n, leaf as h from leaves
  union all
  select lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from tree where n > 1 group by lang, level, pos // 2, n),
subroots as (select lang, h as subroot, row_number() over (order by encode(lang) nulls first) - 1 as pos from tree where n = 1),
top as (
  select 0 as level, pos, count(*) over () as n, subroot as h from subroots
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by level, pos // 2, n),
steps as (
  select l.lang, l.pos, v.level, t.pos % 2 as even, coalesce(t.h, '') as h
  from leaves l join (select distinct lang, level from tree where n > 1) v on v.lang is not distinct from l.lang
  left join tree t on t.lang is not distinct from l.lang and t.level = v.level and t.pos = xor(l.pos >> v.level, 1)
  union all
  select l.lang, l.pos, 1000 + v.level, t.pos % 2, coalesce(t.h, '')
  from leaves l join subroots s on s.lang is not distinct from l.lang cross join (select distinct level from top where n > 1) v
  left join top t on t.level = v.level and t.pos = xor(s.pos >> v.level, 1)),
ways as (select lang, pos, list({{'even': even, 'h': h}} order by level) as way from steps group by lang, pos),
folded as (
  select l.doc_id, l.lang, l.pos, l.leaf, w.way, 1 as i, coalesce(l.tampered, l.leaf) as node from leaves l left join ways w on w.lang is not distinct from l.lang and w.pos = l.pos
  union all
  select doc_id, lang, pos, leaf, way, i + 1, sha256(case when way[i].even = 0 then way[i].h || node else node || way[i].h end) from folded where i <= len(way))
select f.doc_id, f.leaf, s.subroot, r.h as root, sha256(coalesce(list_aggregate(list_transform(f.way, lambda x: x.h), 'string_agg', ''), '')) as proof_sha256,
  f.node as folded_root, f.node = r.h as verified
from folded f join subroots s on s.lang is not distinct from f.lang cross join (select h from top where n = 1) r
where f.i > coalesce(len(f.way), 0)""",
    "op12_prefixes": f"""
with turns as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
    row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as d
  from conversations where conv_id is not null),
sizes as (select c, count(*) as n, {crc32_sql("c::varchar")} % 6 as h from turns group by c),
plan as (select s.c, s.h, s.c - s.c % 100 as b, least(s.h, coalesce(t.n, 0)) as k from sizes s left join sizes t on t.c = s.c - s.c % 100),
rebuilt as (
  select p.c, t.d, t.r, t.x from plan p join turns t on t.c = p.b and t.d <= p.h
  union all
  select p.c, t.d - p.h + p.k, t.r, t.x from plan p join turns t on t.c = p.c and t.d > p.h),
paths as (
  select c, d, length(x) as chars, md5(string_agg(md5(strlen(r) || ':' || r || x), '') over (partition by c order by d)) as p from rebuilt
  union all
  select c, 0, 0, '' from plan),
ends as (select c, max(d) as d from paths group by c),
nodes as (
  select a.d, a.p, min(a.c) as c, count(*) as n, max(a.chars) as chars, coalesce(string_agg(a.c::varchar, ',' order by a.c) filter (where e.d = a.d), '') as ended
  from paths a join ends e using (c) group by a.d, a.p),
ups as (select n.c, n.d, u.c as parent from nodes n join paths q on q.c = n.c and q.d = n.d - 1 join nodes u on u.d = q.d and u.p = q.p),
kids as (select parent as c, d - 1 as d, count(*) as kids from ups group by all),
own as (select n.*, coalesce(k.kids, 0) as kids from nodes n left join kids k using (c, d)),
sums as (
  select q.d, q.p, sum(case when o.kids = 0 then 1 else 0 end) as leaves, sum((o.n - 1) * o.chars) as saved
  from own o join paths q on q.c = o.c and q.d <= o.d group by q.d, q.p)
select o.c as conv_id, o.d as depth, u.parent as parent_conv_id, o.n as n_convs, o.kids as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(o.ended) as ends_sha256
from own o join sums s using (d, p) left join ups u using (c, d)""",
}
