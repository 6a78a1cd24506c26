"""The registered queries of the corpus operators: thin calls over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, html_blocks, hyperminhash, merkle, packing, phrase_graph, quality_rules, residual_packing, rule_ensemble, secret_scan, token_counts, token_files
from .work import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(read(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.query(spark, read(spark, sf_dir, "conversations"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.query(read(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.query(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.query(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.query(read(spark, sf_dir, "documents"))


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.query(read(spark, sf_dir, "documents"))


def op13_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.query(read(spark, sf_dir, "documents"))


def op12_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.query(read(spark, sf_dir, "documents"))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.query(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_files, op3_packing, op4_html_blocks, op5_token_counts, op6_decontaminate, op7_chat_format, op8_rule_ensemble, op9_secret_scan, op10_hyperminhash, op11_residual_packing, op12_octopus_manifest, op13_phrase_graph)}
ORACLES = {"op1_quality_rules": quality_rules.ORACLE_SQL, "op6_decontaminate": decontaminate.ORACLE_SQL, "op7_chat_format": chat_format.ORACLE_SQL, "op12_octopus_manifest": merkle.ORACLE_SQL, "op13_phrase_graph": phrase_graph.ORACLE_SQL}
