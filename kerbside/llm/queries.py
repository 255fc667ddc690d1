"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import bpe, decontaminate, fingerprints, jaccard, langid, merkle, pii, quality, suffixes, toxicity, urls, warc, whitening
from kerbside.llm.common import ID, documents, fold, table


def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, d), table(spark, d, "benchmark"))
    return found.select(ID, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, d))


def op3_language(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    filters = langid.train(docs.filter(fold(F.col(ID), 5) != 0))
    held_out = (fold(F.col(ID), 5) == 0).alias("held_out")
    return langid.predict(docs, filters).select(ID, held_out, "lang_pred", "score")


def op4_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge_urls(table(spark, d, "pages"), urls.labelled_urls(spark))


def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return quality.judge_quality(docs, quality.train(docs, table(spark, d, "labels")))


def op6_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(documents(spark, d)).drop("found")


def replica_of(pages: DataFrame) -> DataFrame:
    """A copy of the archive with losses and changes by a rule, as the audit's other side."""
    html = F.when(F.col("page_id") % 97 == 3, F.concat(F.col("html"), F.lit(" "))).otherwise(F.col("html"))
    return pages.filter("page_id % 101 != 5").withColumn("html", html)


def op7_warc_audit(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    return warc.fixity_audit(pages, replica_of(pages))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    labels = table(spark, d, "labels").filter(fold(F.col(ID), 3) != 1)
    machine = toxicity.train(docs, labels)
    held_out = (fold(F.col(ID), 3) == 1).alias("held_out")
    return toxicity.score_toxicity(docs, machine).select(ID, held_out, "score", "predicted")


def op9_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.similarity_classes(documents(spark, d))


def op10_repeats(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, d))


def op11_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    found = merkle.manifest(documents(spark, d))
    return found.select(ID, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, d))


def op13_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_bpe,
        op3_language,
        op4_url_filter,
        op5_quality,
        op6_personal_data,
        op7_warc_audit,
        op8_toxicity,
        op9_jaccard,
        op10_repeats,
        op11_merkle_manifest,
        op12_fingerprints,
        op13_whitening,
    )
}
