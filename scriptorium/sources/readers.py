"""Scans: packed JSON archives, JSON lines with a side output of bad records, and word exports."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.shipping import ship


def packed_json(spark: SparkSession, path: str, folder: str = "packs") -> DataFrame:
    """(pack, ordinal, entry, error) of every entry of the JSON members `<folder>/*.json` of ZIP archives.

    A member that is no JSON, and an archive that is no ZIP (pack: its name),
    gives one row with its error, and the rest is read; entry is the entry's JSON
    text, for parse_json or from_json.
    """
    ship(spark)

    def members(name: str, content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for member in sorted(z.namelist()):
                    parent, _, file = member.rpartition("/")
                    if file.endswith(".json") and parent.rpartition("/")[2] == folder and file != "_folders.json":
                        try:
                            yield file.removesuffix(".json"), z.read(member), None
                        except (zipfile.BadZipFile, OSError, RuntimeError, zlib.error) as e:
                            yield file.removesuffix(".json"), None, str(e)
        except (zipfile.BadZipFile, OSError) as e:
            yield name, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for pack, data, error in members(path.rpartition("/")[2], content):
                    try:
                        if data is None:
                            raise ValueError(error)
                        told = json.loads(data)
                        entries = told if isinstance(told, list) else list(told.values()) if all(isinstance(v, dict) for v in told.values()) else [told]
                        yield pd.DataFrame({"pack": pack, "ordinal": range(len(entries)), "entry": [json.dumps(e, sort_keys=True, ensure_ascii=False) for e in entries], "error": None})
                    except (ValueError, AttributeError) as e:
                        yield pd.DataFrame({"pack": [pack], "ordinal": [0], "entry": [None], "error": [str(e)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "pack string, ordinal int, entry string, error string")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of JSON lines."""
    bad = "_bad"
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad}).alias("r"))
    wrong = F.col("r").isNull() | F.col(f"r.{bad}").isNotNull()
    return rows.filter(~wrong).select("r.*").drop(bad), rows.filter(wrong).select(F.col("value").alias("line"))


WORD_EXPORT = (
    "schema_version int, source struct<filename:string,sha256:string,size:bigint,page_count:int>, pages array<struct<number:int,width:double,height:double,"
    "words:array<struct<text:string,x0:double,top:double,x1:double,bottom:double,font:string,size:double>>>>"
)


def page_words(spark: SparkSession, path: str) -> DataFrame:
    """(filename, page, ordinal, text, x0, top, x1, bottom, font, size) of word exports."""
    pages = spark.read.schema(WORD_EXPORT).option("multiLine", True).json(path).select("source.filename", F.explode("pages").alias("p"))
    words = pages.select("filename", F.col("p.number").alias("page"), F.posexplode("p.words").alias("ordinal", "w"))
    return words.select("filename", "page", "ordinal", "w.*")


def entry_level(entry: str = "entry"):
    """The level of an entry, which may be a number or an object with `value`."""
    v = F.try_parse_json(entry)
    return F.coalesce(F.try_variant_get(v, "$.system.level.value", "int"), F.try_variant_get(v, "$.system.level", "int"))
