"""Queries p7-p9 over the corpus."""

from __future__ import annotations

import importlib.util
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.abuse import abuse_rates, abuse_scores
from tidelog.llm.encode import decode_ids, encode_texts
from tidelog.llm.leak import leaked_passages, near_passages
from tidelog.runtime import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file: in TIDELOG_TOKENIZERS, or where the installed package of vocabularies is."""
    folder = os.environ.get("TIDELOG_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text", vocabulary())


def p7_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts back from their ids."""
    return decode_ids(p7_ids(spark, d), "doc_id", "ids", vocabulary())


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 10 of 12 successive words of an item at their places."""
    return near_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(table(spark, d, "documents"), "doc_id", "text").where("is_abusive").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(table(spark, d, "documents"), "doc_id", "text")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse_rates(table(spark, d, "documents"), "doc_id", "text", "source")


def queries() -> dict:
    return {f.__name__: f for f in (p7_ids, p7_text, p8_found, p8_near, p9_found, p9_scores, p9_rates)}


SQL: dict[str, str] = {"p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
MODULES = [sys.modules[__name__]]
