"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import negatives, repair, rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op7_near_copies")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from .setjoin import near_copies

    return near_copies(table(spark, folder, "documents"), size=4, percent=85)


@query("op1_attention_quality")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_capped_mixture")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from .mixing import mixture

    return mixture(table(spark, folder, "documents"), budget=1.5, epochs=2.0)


@query("op3_line_rules", rules.SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return rules.line_rules(table(spark, folder, "documents"))


@query("op4_log_bilinear")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from .logbilinear import lm_scores

    return lm_scores(table(spark, folder, "documents"))


@query("op5_interleaved_media")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from .media import document_media

    return document_media(table(spark, folder, "documents"))


@query("op6_weak_supervision_pii")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, folder, "documents"))


@query("op8_convolutional_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, folder, "documents"))


@query("op10_revisit_resolution", warc.SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_revisits(table(spark, folder, "pages"))


@query("op13_trie_repair", repair.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repairs(table(spark, folder, "conversations"))


@query("op12_pigeonhole_simhash")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from .simhash import near_prints

    return near_prints(table(spark, folder, "documents"))


@query("op11_dual_tree_negatives", negatives.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"))
