"""The operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.testbed import table
from .chat import format_chats
from .common import with_package
from .decontamination import find_contained
from .hard_negatives import mined
from .line_dedup import line_report
from .online_packing import packing_report
from .packing import pack
from .quality import judge_quality
from .simhash import near_duplicates
from .substring_dedup import repeated_passages
from .toxicity import toxicity_report
from .url_filter import judge_urls
from .warc import archive_report
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_decontamination(spark, sf_dir):
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


def op5_warc(spark, sf_dir):
    return archive_report(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark, sf_dir):
    return judge_quality(table(spark, sf_dir, "documents")).drop("distance")


def op7_simhash_golay(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark, sf_dir):
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    return mined(table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_online_packing(spark, sf_dir):
    return packing_report(table(spark, sf_dir, "documents"))


_QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_golay": op7_simhash_golay,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_online_packing": op13_online_packing,
}

QUERIES: dict[str, Query] = {name: with_package(query) for name, query in _QUERIES.items()}
