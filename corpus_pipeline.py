"""A training corpus from the table ``documents``, stage by stage.

Every stage takes all documents that its predecessor kept and returns the columns of ``documents``;
the last one adds what the mix decided. Between the stages the documents are written and read again.

In all stages: an empty table gives no rows; further columns of any name are kept as they are, except that in the
last stage columns named as the mix's own are replaced; equal rows are rows of their own, except that of
near duplicates one stays; texts of any length are taken whole; a null id, source or ``n_chars`` is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.catalogue import PII_KEY, language_training
from rackwise.llm.common import read_table, stored
from rackwise.llm.decontamination import find_contamination, remove_spans
from rackwise.llm.language import fit_languages, identify_language
from rackwise.llm.mixing import mix
from rackwise.llm.near_duplicates import keep_one
from rackwise.llm.pii import replace_personal_data


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; ``n_chars`` follows the changed text."""
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*columns.values())


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the identification rejects go.

    Null and empty texts, and texts without letters, are rejected. Without any labelled text all documents are.
    Ties go to the first language.
    """
    judged = identify_language(docs, fit_languages(language_training(docs)))
    return judged.where(~F.col("rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id.

    Equal texts, empty ones too, are one group; a null text is a group of its own. Of equal rows one stays.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the spans that benchmark windows cover.

    Null and empty texts stay as they are; an item without id or text covers nothing. Repeated rows lose the same spans.
    """
    found = find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return _with_text(found.withColumn("text", remove_spans(F.col("text"), F.col("spans"))), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data.

    Null and empty texts stay as they are. One entity has one surrogate wherever it stands, so repeated rows stay equal.
    """
    return _with_text(replace_personal_data(docs, PII_KEY), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies.

    Null and empty texts have no words; what is taken of them adds nothing. Documents of a null source are a source of their
    own. Ties in size are broken by a hash, so reruns agree; equal rows are interchangeable.
    """
    return mix(docs).where("copies > 0")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mix", mixed),
]

# Clusters, sketches and random rounding can't be said in SQL; the stages' tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
