"""A corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import jaccard, ordinal, packing, rules, secret_scan
from tracewell.llm.queries import table, tokenizer_path
from tracewell.llm.shared import drop, kept


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct, so that no name clashes with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias(_FILL)).alias(_REST))


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order, of rows that _carried() made."""
    return rows.select(*[c if c in ("doc_id", "text") else F.col(f"`{_REST}`.`{c}`") for c in docs.columns])


_REST, _FILL = "columns of the documents", "a struct has a column"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the top grade, well made and clean, reaches the mark.

    Null text is judged as an empty one. Repeated rows share a verdict; a null
    doc_id has no rating and is judged like others; other columns stay as they
    are, whatever their names; an empty table gives no rows.
    """
    model = ordinal.fit_on(docs, table(spark, sf_dir, "labels"))
    return _restored(ordinal.score(_carried(docs), model).filter(F.col("p_2") >= ordinal.KEEP), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio of trusted target to raw corpus.

    Null and empty texts fail the base. Repeated rows share a verdict; a null
    doc_id is not trusted and is judged like others; other columns stay as
    they are, whatever their names; an empty table gives no rows.
    """
    ratio = rules.ratio_table(docs, table(spark, sf_dir, "labels"))
    return _restored(rules.judge(_carried(docs), ratio).filter("kept"), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the least by doc_id, a null one last, then by its text's hash.

    Of rows that repeat an id and a text one stays. Rows of one id with
    different texts are documents of their own. Rows without words all stay;
    other columns stay as they are; an empty table gives no rows.
    """
    return jaccard.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind, and n_chars, where there is one, counted anew.

    Null text stays null, with its n_chars. Repeated rows, null ids and other
    columns stay as they are; an empty table gives no rows.
    """
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document, packed into sequences; one row a piece.

    A null or empty text is the end id alone; repeated rows are packed once
    each; a null doc_id stays null; other columns go; an empty table gives no
    rows.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: the classifier is fitted by numpy, which SQL cannot express; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = before = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
        if hasattr(before, "kept_at"):
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
