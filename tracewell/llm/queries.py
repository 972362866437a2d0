"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import jaccard, media, oracles, ordinal, packing, pseudo_lm, rules, secret_scan, shared, token_files, unigram, url_lists


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def captures_and_list(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """pages with a fetch day each, and a dated list over their hosts and first path segments.

    The tables have no dates and no list, so both follow by rule: from page_id,
    and from the MD5 of a pattern. The list grows with the pages.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    pages = pages.withColumn("fetched_at", F.expr("date_add(date '2024-01-01', cast(pmod(page_id * 7919, 366) as int))"))
    found = pages.select(F.explode(url_lists.patterns_of(F.col("url"), 1)).alias("pattern")).distinct()
    h = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")
    day = "date_add(date '2024-01-01', cast({} as int))"
    dated = found.withColumn("h", h).filter("h % 3 <> 0").withColumn("list", F.when(F.expr("h % 2 = 0"), "spam").otherwise("legal"))
    events = F.array(
        F.struct(F.expr(day.format("h % 300")).alias("listed_at"), F.lit("add").alias("action")),
        F.struct(F.expr(day.format("h % 300 + 1 + h % 97")).alias("listed_at"), F.lit("remove").alias("action")),
        F.struct(F.expr(day.format("h % 300 + 1 + h % 97 + h % 11")).alias("listed_at"), F.lit("add").alias("action")),
    )
    return pages, dated.select("list", "pattern", F.explode(events).alias("e")).select("list", "pattern", "e.listed_at", "e.action")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.judge(*captures_and_list(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudo_lm.score(docs, *pseudo_lm.fit(docs)).drop("text")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit_on(docs, table(spark, sf_dir, "labels"))
    scored = ordinal.score(docs, model)
    return scored.select("doc_id", "expected_grade", "p_1", "p_2", (scored["p_2"] >= ordinal.KEEP).alias("kept"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.shared_path(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), path)
    found = token_files.count_tokens(spark, path)
    # the writer's file names hold a random part; their number does not
    return found.withColumn("file", F.regexp_extract("file", r"^part-(\d+)-.*-c(\d+)", 0)).withColumn("file", F.regexp_replace("file", r"^part-(\d+)-.*-c(\d+)$", "$1-$2"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs, rules.ratio_table(docs, table(spark, sf_dir, "labels"))).drop("text")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filters": op3_url_filters,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_media_columns": op8_media_columns,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_secret_scans": op10_secret_scans,
}
ORACLES: dict[str, str] = {"op3_url_filters": oracles.URL_LISTS, "op9_jaccard_join": oracles.JACCARD, "op10_secret_scans": oracles.secret_scans()}
