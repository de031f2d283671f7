"""The queries opN_<name> of this subpackage, with production parameters, and SQL for those that SQL can
express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import bpe, convtrie, dedup, flac, langid, mixing, sharding, simjoin, spelling, tokenstore, toxicity, urlfilter, warc
from tilespark.llm.common import scratch


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.common import held_out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.apply(docs, model)
    return out.select("doc_id", held_out(out["doc_id"]).alias("held_out"), "score", "predicted")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    tokenstore.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer("word_bpe_49k.json"))
    return tokenstore.read_back(spark, path)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("byte_bpe_50k.json"))


RULES = [
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.through_store(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24, map_path=scratch(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def plan() -> mixing.Plan:
    """Domain (web for sources src0 to src9, else books), language, source."""
    number = F.try_to_number(F.regexp_extract("source", r"^src(\d+)$", 1), F.lit("999999"))
    domain = F.when(number < 10, "web").otherwise("books")
    return mixing.Plan(
        levels=[("domain", domain), ("lang", F.col("lang")), ("source", F.col("source"))],
        weights={"web": 0.55, "books": 0.45, "web/en": 0.5, "books/en": 0.5},
        total=0.9, epochs=2, seed=17,
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), plan())
    return mixed.select("doc_id", F.col("_path").alias("leaf"), F.col("_epoch").alias("epoch"), F.col("_tokens").alias("tokens"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_back(spark, path)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_language_id": op1_language_id, "op2_url_filter": op2_url_filter, "op3_exact_dedup": op3_exact_dedup,
    "op4_flac": op4_flac, "op5_sharding": op5_sharding, "op6_ngram_join": op6_ngram_join, "op7_mixing": op7_mixing, "op8_toxicity": op8_toxicity,
    "op9_token_store": op9_token_store, "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie, "op12_warc": op12_warc, "op13_spelling_variants": op13_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op11_prefix_trie": convtrie.oracle(),
    "op12_warc": warc.oracle(),
    "op13_spelling_variants": spelling.oracle(),
    "op2_url_filter": urlfilter.oracle(RULES),
    "op3_exact_dedup": """with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as n from d group by norm)
select d.doc_id, g.keep_id, g.n as group_size, d.doc_id = g.keep_id as kept, sha256(d.norm) as text_sha256 from d join g using (norm)""",
    "op6_ngram_join": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
d as (select distinct doc_id, g from s), n as (select doc_id, count(*) as n from d group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from d a join d b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * p.i >= 85 * (x.n + y.n - p.i)),
e as (select a, b from l union all select b, a from l),
r(id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.id)
select t.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from documents t left join n on t.doc_id = n.doc_id join (select id, min(root) as component_id from r group by id) c on t.doc_id = c.id""",
}
