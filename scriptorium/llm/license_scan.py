"""Licence scans by canonical digest lookup, in DataFrame functions alone.

A text is brought to a canonical form (case, copyright lines, equivalent
spellings, punctuation), hashed, and looked up among the digests of known licence
texts by a hash join: whole documents against whole licences, and each line, as a
text of its own, against known notices too.  The known side is this package's
fixed list, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.license_texts import NOTICES, WHOLE_DIGESTS, WHOLE_TEXTS

# What is rewritten, in order; patterns that Java and RE2 read alike
_COPYRIGHT = r"(^|\n)[ \t#*/;>-]*(copyright[ \t]*(\(c\)|©|[0-9][0-9][0-9][0-9])|\(c\)[ \t]*(copyright|[0-9][0-9][0-9][0-9])|©)[^\n]*"
_RESERVED = r"(^|\n)[ \t#*/;>-]*all rights reserved\.?[ \t]*"
_SPELLINGS = [
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"http://", "https://"),
    (r"&", " and "),
    (r"organis", "organiz"),
    (r"whilst", "while"),
]
_REST, _IN_LINES = r"[^a-z0-9]+", r"[^a-z0-9\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, with a line feed between two.

    No pattern here reaches over a line feed, so a line comes out as it would
    alone, but for blanks at its ends.
    """
    x = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (_COPYRIGHT, _RESERVED):
        x = F.regexp_replace(x, pattern, "\n")
    for old, new in _SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.regexp_replace(x, _IN_LINES, " ")


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), r"[ \n]+", " "))


def known(spark: SparkSession, texts: list[tuple[str, str]], digests: list[tuple[str, str]]) -> DataFrame:
    """(license, digest, size) of known texts, one row a digest; size: characters of the canonical form, null where only the digest is known."""
    rows = spark.createDataFrame(texts, "license string, text string")
    form = canonical(F.col("text"))
    made = rows.select("license", F.sha2(form, 256).alias("digest"), F.length(form).alias("size"))
    told = spark.createDataFrame(digests, "license string, digest string").select("license", "digest", F.lit(None).cast("int").alias("size"))
    return made.union(told).groupBy("digest").agg(F.min("license").alias("license"), F.max("size").alias("size"))


def scan_licenses(
    df: DataFrame, key: str = "doc_id", text: str = "text", whole: list[tuple[str, str]] = WHOLE_TEXTS, notices: list[tuple[str, str]] = NOTICES, digests: list[tuple[str, str]] = WHOLE_DIGESTS
) -> DataFrame:
    """(key, digest, whole_license, line_licenses, n_license_lines) of every row.

    whole_license: of the known text that the whole document is, or null;
    line_licenses: the distinct licences of lines that are a known text or
    notice, sorted, comma-joined.  Null and empty texts have the digest of the
    empty text, and no licence, as have texts without a letter or number; rows
    of one key are told apart by their texts, and are alike where those are equal;
    a null key is a key; other columns play no part; an empty table gives no rows.
    """
    spark, body = df.sparkSession, df[text].cast("string")
    rows = df.select(df[key].alias("key"), F.xxhash64(body).alias("row"), canonical_lines(body).alias("lines"))
    docs = rows.select("key", "row", F.sha2(F.trim(F.regexp_replace("lines", r"[ \n]+", " ")), 256).alias("digest"))
    every = known(spark, [x for x in whole + notices if x[1]], [])
    # only lines of a known length are hashed; the lengths are of a fixed list
    sizes = sorted(r.size for r in every.select("size").distinct().collect() if r.size)
    found = F.filter(F.transform(F.split("lines", "\n"), lambda x, i: F.struct(F.trim(x).alias("words"), i.alias("line"))), lambda x: F.length(x["words"]).isin(sizes))
    lines = rows.select("key", "row", F.explode(found).alias("x")).select("key", "row", "x.line", F.sha2("x.words", 256).alias("line_digest"))
    hits = lines.join(F.broadcast(every.select(F.col("digest").alias("line_digest"), "license")), "line_digest")
    hits = hits.groupBy("key", "row").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"), F.countDistinct("line").alias("n"))
    hits = hits.select(F.col("key").alias("k"), F.col("row").alias("r"), "line_licenses", "n")
    out = docs.join(F.broadcast(known(spark, whole, digests).select("digest", F.col("license").alias("whole_license"))), "digest", "left")
    out = out.join(hits, out["key"].eqNullSafe(hits["k"]) & (out["row"] == hits["r"]), "left")
    return out.select(out["key"].alias(key), "digest", "whole_license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n", F.lit(0)).alias("n_license_lines"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_canonical(x: str) -> str:
    x = f"lower(coalesce({x}, ''))"
    for pattern in (_COPYRIGHT, _RESERVED):
        x = f"regexp_replace({x}, '{pattern}', chr(10), 'g')"
    for old, new in _SPELLINGS:
        x = f"replace({x}, '{old}', '{new}')"
    return f"trim(regexp_replace({x}, '{_REST}', ' ', 'g'))"


def oracle() -> str:
    """DuckDB SQL for scan_licenses over documents."""
    values = lambda texts: ", ".join(f"('{n}', {_sql_text(t)})" for n, t in texts)
    make = lambda texts: f"SELECT min(l) AS license, sha256({_sql_canonical('t')}) AS digest FROM (VALUES {values(texts)}) AS v(l, t) GROUP BY 2"
    values_of_digests = ", ".join(f"('{n}', '{d}')" for n, d in WHOLE_DIGESTS)
    return (
        f"WITH g AS (SELECT * FROM (VALUES {values_of_digests}) AS v(license, digest)), w AS (SELECT min(license) AS license, digest FROM (SELECT * FROM ({make(WHOLE_TEXTS)}) UNION ALL SELECT * FROM g) GROUP BY digest), e AS ({make(WHOLE_TEXTS + NOTICES)}), d AS (SELECT doc_id, text, row_number() OVER () AS rn, sha256({_sql_canonical('text')}) AS digest FROM documents), "
        "l AS (SELECT rn, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM d), "
        f"h AS (SELECT rn, string_agg(DISTINCT license, ',' ORDER BY license) AS ll, count(*) AS n FROM l JOIN e ON e.digest = sha256({_sql_canonical('x')}) WHERE x <> '' GROUP BY rn) "
        "SELECT d.doc_id, d.digest, w.license AS whole_license, coalesce(h.ll, '') AS line_licenses, coalesce(h.n, 0) AS n_license_lines FROM d LEFT JOIN w USING (digest) LEFT JOIN h USING (rn)"
    )
