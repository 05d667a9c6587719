"""The queries of this subpackage over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.chat_format import oracle as chat_oracle
from scriptorium.llm.frames import table
from scriptorium.llm.license_scan import oracle as license_oracle
from scriptorium.llm.secret_scan import oracle as secret_oracle


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), limit=512)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.token_files import token_round_trip

    return token_round_trip(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), alphabet=49408, end_id=1, kind="word")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.chat_format import as_tool_chats, format_chats

    return format_chats(as_tool_chats(table(spark, sf_dir, "conversations")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), length=2048, end_id=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_neighbours": op3_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_files": op8_token_files,
    "op9_chat_format": op9_chat_format,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": secret_oracle(),
    "op5_license_scan": license_oracle(),
    "op9_chat_format": chat_oracle(),
}
