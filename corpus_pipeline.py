"""A corpus pipeline of five of the training-data operators. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlab.llm import jaccard_join, language_id, packing, quality_rules, secret_scan
from tenorlab.llm._common import materialize, read, ship_code
from tenorlab.llm.bpe import default_vocabulary

#: Near-duplicates in the pipeline: shingles of so many words, similarity of so many hundredths or more.
SHINGLE, PERCENT = 5, 80


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names with as many underscores as no column of ``docs`` has."""
    out = list(names)
    while set(out) & set(docs.columns):
        out = [f"{n}_" for n in out]
    return tuple(out)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go.

    A null or empty text, or one without letters, has none. Repeated rows are judged alike; a row's id and label do not count; other columns
    stay, whatever their names. Without labelled rows no language is known and all documents go; an empty table stays empty.
    """
    ship_code(spark)
    model = language_id.train(docs, ~language_id.held_out())
    out = _free(docs, "lang_pred", "lang_score")
    kept = (F.col(out[0]) != language_id.UNKNOWN) & (F.col(out[1]) >= language_id.MIN_SCORE)
    return language_id.predict(docs, model, out).where(kept).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Texts are counted once and not shuffled.

    A null or empty text goes. Repeated rows are judged alike, ties share a verdict, other columns stay, an empty table stays empty.
    """
    return quality_rules.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the smallest id.

    Null and empty texts stay. Of rows that repeat id and text one stays, always the same. An empty table stays empty.
    """
    ship_code(spark)
    return jaccard_join.keep_one(docs, SHINGLE, PERCENT)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked in the texts and n_chars follows; every document stays.

    Null and empty texts stay as they are, repeated rows are masked alike, an empty table stays empty.
    """
    masked = secret_scan.redact(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of what is left; a null or empty text is its closing token, repeated rows are packed each, an empty table packs to none."""
    ship_code(spark)
    return packing.pack_documents(docs, default_vocabulary())


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage), ("jaccard_join", dedup_stage), ("secret_scan", secret_stage), ("best_fit_packing", packing_stage)]

#: Shingles by similarity, a trained classifier and packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
