"""Corpus pipeline: quality rules, quality classifier, near-duplicates, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept.  All but the last return the columns of ``documents``.  ``run`` applies
them to the documents table; what a stage returns is written as Parquet to the
shared folder and read again as the next stage's ``docs``.

* quality rules: documents that fail the base rules or whose content share is low go;
* quality classifier: documents scored under 0.5 go;
* near-duplicates (five words, similarity 0.8): of each group one row stays, that of the
  smallest doc_id;
* secret scan: reported spans are masked in the text, ``n_chars`` follows;
* packing: pieces of power-of-two length with their token ids.

The two models are fitted on the labelled rows of the whole documents table.
Rows with a null text fail the first stage; rows with a null or repeated doc_id are
documents of their own, a null comes last where a group's row is chosen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import labelled, line_crf, minhash_oph, packing, quality_cnn, secret_links
from ledgerlens.llm.common import prepare, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return line_crf.keep_good(docs, line_crf.fit(labelled.training(spark, sf_dir)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_cnn.keep_good(docs, quality_cnn.fit(labelled.training(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return minhash_oph.deduplicate(docs, k=5, percent=80, repeats=False)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_links.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("minhash near-dedup", near_duplicates),
          ("secret scans", secret_scan), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
