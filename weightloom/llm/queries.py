"""The registered queries of this subpackage and their SQL: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.llm import bpe, licenses, media, oracles, packing, quality, simhash, suffixes, token_files, urls, warc
from weightloom.llm.common import documents, pages

#: Where the vocabularies lie; a parameter of the operators.
WORDS, MULTI = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), MULTI, public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(documents(spark, sf_dir), WORDS)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by a check of their html; rules are mined from the labelled URLs and judge all."""
    return urls.judge(pages(spark, sf_dir), urls.html_labels(pages(spark, sf_dir)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(documents(spark, sf_dir), WORDS))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(documents(spark, sf_dir))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(pages(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_quality_rules, op3_packing, op4_url_filters, op5_license_scan, op6_suffix_dedup, op7_token_files, op8_simhash, op9_media, op10_warc)}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
