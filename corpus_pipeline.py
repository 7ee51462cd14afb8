"""Documents to training data in five stages, each one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bagminhash, bpe, decontaminate, language, secrets
from tidewheel.llm.common import materialise, spare, table

#: Share of a text's letters that its main language needs.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language, or of which no language has half of the letters.

    So null and letterless texts go; ties and repeated rows stay or go alike. Rows
    without a label or key are not learned from.
    """
    model = language.train(docs.filter(F.col("doc_id").isNotNull() & ~language.held_out()))
    name = spare(docs, "language")
    found = language.identify(docs, model, into=name)
    return found.filter((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_SHARE)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, the one with the least key (null is last).

    Texts without words are classes of their own; of rows with equal key and text
    one stays.
    """
    return bagminhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark text; null and empty texts have none."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace live-looking secrets in the texts; widely copied examples stay, and so do all rows; null stays null."""
    return secrets.redact(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a proof that they decode to its text; null is empty."""
    name = spare(docs, "coded")
    return bpe.encode_decode(docs, bpe.vocabulary_path(), into=name).select("doc_id", "lang", "source", *bpe.digests(name))


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("BPE", bpe_encode),
]

#: Models, signatures and merges have no SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
