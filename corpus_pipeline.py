"""The corpus pipeline: stages over ``documents``, each written as Parquet and
reread as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectic.llm import decontaminate, language, packing, pii, simhash
from dialectic.llm.frames import id_remainder, stored, table

#: Documents whose best language has a smaller mean probability go.
LEAST_LANGUAGE_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that was learned, go."""
    found = language.identify(docs, docs.filter(id_remainder("doc_id", 5) != 0).select("text", "lang"))
    lang, score = language.added_names(docs.columns)
    keep = language.known(F.col(lang)) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return found.filter(keep).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (the smallest id)."""
    return simhash.drop_near_duplicates(docs, shingle_words=3, max_bits=2)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; every document stays."""
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 ids; one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("language", known_language), ("near_duplicates", near_duplicates), ("decontamination", benchmark_free),
          ("pii", personal_data), ("packing", packed)]

#: SQL can state neither the fingerprints nor the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
