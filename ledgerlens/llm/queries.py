"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (html_blocks, knn_tiles, labelled, langid_nb, line_crf, minhash_oph, oracles, packing, periodic_runs, quality_cnn, secret_links,
               sentencepiece_codec, spelling_kd, token_files, warc_chunks)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"))


@register("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"))


@register("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


@register("op3_quality_cnn")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score(table(spark, sf_dir, "documents"), quality_cnn.fit(labelled.training(spark, sf_dir)))


@register("op4_line_crf")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judge(table(spark, sf_dir, "documents"), line_crf.fit(labelled.training(spark, sf_dir)))


@register("op5_langid_nb")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid_nb.identify(docs, langid_nb.fit(docs))


@register("op6_html_blocks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@register("op7_minhash_oph", oracles.NEAR_DUPLICATES)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_oph.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@register("op9_secret_links", oracles.SECRETS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.scan(table(spark, sf_dir, "documents"))


@register("op10_knn_tiles", oracles.NEAREST)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_tiles.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@register("op12_periodic_runs", oracles.PERIODIC_RUNS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


@register("op13_spelling_kd", oracles.SPELLING)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_kd.group_variants(table(spark, sf_dir, "documents"))


@register("op11_warc_chunks", oracles.WARC)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.digest(table(spark, sf_dir, "pages"))
