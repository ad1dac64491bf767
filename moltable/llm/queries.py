"""The registered queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltable.llm.columns import WORD
from moltable.runtime import new_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PACK_END, FILE_END = 1, 0


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["name"] == kind)).cast("bigint").alias(f"n_{kind}")


@_query
def op5_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.packing import pack_documents

    packed = pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), PACK_END)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_query
def op7_pfor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.idfiles import read_id_files, write_id_files

    path = new_path(spark, "token-ids")
    write_id_files(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), FILE_END)
    return read_id_files(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_query
def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.85)


@_query
def op10_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.secrets import find_secrets, listed

    found = find_secrets(_table(spark, sf_dir, "documents"))
    kinds = ("assign", "access", "hex")
    counts = [_count("base_spans", k) for k in kinds]
    digest = F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, listed(F.col("secret_spans")).alias("spans"))


@_query
def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.mixing import mix_sources

    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    taken = (F.col("mix.size") * F.col("mix.copies")).alias("taken")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken, "mix.copies", "source")


@_query
def op3_sketch_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.thresholds import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents")).drop("lang", "source", "n_lines")


KEEP_SCORE = 0.3


@_query
def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.columns import held_out
    from moltable.llm.crf import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, _table(spark, sf_dir, "labels")), ["doc_id"])
    predicted = (F.col("quality") >= KEEP_SCORE).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), predicted)


@_query
def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op6_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.wordpiece import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@_query
def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.pii import KINDS, find_personal_data, train_on

    docs = _table(spark, sf_dir, "documents")
    found = find_personal_data(docs, train_on(docs))

    def listed(spans: str) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    digest = F.sha2(listed("base_spans"), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, KINDS), digest, listed("spans").alias("spans"))


URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@_query
def op13_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.cascade import judge_urls

    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


_fits = ",\n        ".join(
    f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}' END"
    for _, host, path in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
)
_blocked = ", ".join(f"'{host}{path}'" for verdict, host, path in URL_RULES if verdict == "block")
SQL["op13_bloom_cascade"] = f"""
    WITH rests AS (
        SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM rests
    ), fitted AS (SELECT *, coalesce({_fits}) AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ({_blocked}) THEN 'block' ELSE 'allow' END AS verdict FROM fitted
"""


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by the hash of their id, all words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hashed = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("planted"))
    listed = hashed.withColumn("words", F.when(F.col("planted"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    counted = listed.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    counted = counted.withColumn("left", F.col("n") - F.col("a"))
    counted = counted.withColumn("p", 1 + F.floor(F.col("left") / (3 + F.col("g") % 8)).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.flatten(F.array_repeat(period, F.ceil(F.col("left") / F.col("p")).cast("int")))
    whole = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), F.col("left")))
    return counted.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.periodic import periodic_runs

    found = periodic_runs(_with_planted_runs(_table(spark, sf_dir, "documents")))
    ranked = F.transform(
        "runs", lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", F.array_max(ranked)).select(
        "doc_id",
        "n_words",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.round(F.col("best.exponent") * -F.col("best.period")).cast("bigint").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return best.withColumn("exponent_milli", F.expr("1000 * length div period"))


@_query
def op11_diagonal_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moltable.llm.align import align_documents, with_pair_counts

    aligned = align_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return with_pair_counts(stage(aligned.select("*", digest).drop("groups"), "aligned"))
