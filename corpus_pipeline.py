"""A training corpus from raw documents: toxicity, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.decontaminate import leaks
from scriptorium.llm.frames import materialise, table
from scriptorium.llm.near_dedup import one_of_each
from scriptorium.llm.packing import pack
from scriptorium.llm.secret_scan import redact
from scriptorium.llm.toxicity import scored, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle and per cent of similarity of near duplicates.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, keep=tuple(c for c in COLUMNS if c != "doc_id")).filter("predicted = 0").select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of the least id; rows that are not near any other all stay, repeated ones once."""
    return one_of_each(docs.select(*COLUMNS), SHINGLE_WORDS, SIMILAR_PERCENT)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    held = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("k")).distinct()
    held = materialise(held, "leaks")
    return docs.join(held, docs["doc_id"].eqNullSafe(held["k"]), "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars is counted anew for those that had any."""
    return redact(docs, "[SECRET]", size="n_chars").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), length=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The stages learn, sketch and tokenise; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
