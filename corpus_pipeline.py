"""The corpus pipeline: quality classifier, quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import common, near_dup, packing, quality, rules, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches one half; learnt from the labels that are not held out.

    Null and empty texts are scored like any other, repeated rows stay or go together, ids may be null. Without labels
    of both kinds, or without documents, all rows stay. Columns may have any names.
    """
    model, score = quality.learn(docs, common.table(spark, sf_dir, "labels")), common.unused(docs, "score")
    return quality.score(docs, model, score_col=score).where(F.col(score) >= 0.5).select(docs.columns)


def keep_ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects.

    Null and empty texts have no words and go; repeated rows stay or go together, ids may be null; an empty table stays
    empty. Columns may have any names.
    """
    rule = common.unused(docs, "rule")
    return rules.judge(docs, rule_col=rule).where(F.col(rule).isNull()).select(docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id, once.

    A row is known by its id and its text, as ids may be repeated with other texts. Rows without an id come after all
    others of their group; of equal ids, the text of the least hash stays. Null and empty texts are near to nothing:
    they stay, those of one id once. An empty table stays empty; other columns may have any names.
    """
    key = common.unused(docs, "key")
    own = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = docs.withColumn(key, own)
    kept = near_dup.clusters(rows, id_col=key).where("kept").select(F.col("id").alias(key)).distinct()
    return rows.join(kept, key).dropDuplicates([key]).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text.

    Repeated rows and copies are treated alike, ids may be null; null texts stay null, with an n_chars of null. An empty
    table stays empty; other columns may have any names.
    """
    ledger = secrets.Ledger(common.shared_dir(spark))
    ledger.update(docs)
    out = ledger.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences.

    Null and empty texts are an end mark alone; repeated rows are packed as often as they come, ids may be null; an
    empty table gives no pieces. Other columns are not read.
    """
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", keep_good), ("quality rules", keep_ruled), ("near-duplicates", keep_one), ("secret scans", redact_secrets), ("packing", pack)]
#: A trained classifier and a tokenizer decide: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each but the last one's rows written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
