"""Secret scans by a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived
that every match must satisfy.  Postings (trigram to documents) are built for
the trigrams of those queries, in blocks of documents so that no posting list
grows without bound; intersections and unions of postings give the candidates of
a rule, and only those are verified with the expression.  A rule without a
mandatory trigram scans every text.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.frames import checked_broadcast, materialise

#: Documents of a posting block, about.
BLOCK_DOCS = 4096


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose group `group` has `least` characters.

    Patterns keep to what Java's, Python's and RE2's engines read alike.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base kinds, in the order that spans of one start are listed
_WORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
BASE_RULES = (
    Rule("assign", rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE_RULES + ADDED_RULES

# ---- trigram queries -------------------------------------------------------

#: Alternative spellings that are told apart, and characters of a class.
_MOST_SPELLINGS, _MOST_CLASS = 256, 8


def _class_chars(items: list) -> set[str] | None:
    """Lower-case characters of a class, or None for a large or negated one."""
    chars: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            chars.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < _MOST_CLASS:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return chars if len(chars) <= _MOST_CLASS else None


def _clauses(spellings: set[str]) -> list[frozenset[str]] | None:
    """Any of these sets of trigrams, each in full; None: nothing is mandatory."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in spellings}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _walk(items, open_: set[str], found: list) -> set[str]:
    """Extends the spellings `open_` by a sequence; what can't be extended is closed into `found`."""

    def close(now: set[str]) -> set[str]:
        if clauses := _clauses(now):
            found.append(clauses)
        return {""}

    def extend(now: set[str], more: set[str]) -> set[str]:
        if len(now) * len(more) > _MOST_SPELLINGS:
            now = close(now)
        return {a + b for a, b in product(now, more)}

    for op, value in items:
        if op is sre.LITERAL:
            open_ = extend(open_, {chr(value).lower()})
        elif op is sre.IN and (chars := _class_chars(value)) is not None:
            open_ = extend(open_, chars)
        elif op is sre.SUBPATTERN:
            open_ = _walk(value[3], open_, found)
        elif op is sre.BRANCH:
            ends = [(_walk(alt, {""}, inner := []), inner) for alt in value[1]]
            if all(not inner for _, inner in ends):
                open_ = extend(open_, set().union(*(end for end, _ in ends)))
            else:
                open_ = close(open_)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = value
            once = _walk(body, {""}, inner := [])
            if not inner and (least, most) == (0, 1):
                open_ = extend(open_, once | {""})
            elif not inner and least == most:
                for _ in range(least):
                    open_ = extend(open_, once)
            else:
                open_ = close(extend(open_, once) if least and not inner and "" not in once else open_)
                found += inner if least else []
        else:
            open_ = close(open_)
    return open_


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """The query of a pattern: of each clause list, some set must be there in full; empty: nothing is mandatory."""
    found: list[list[frozenset[str]]] = []
    if clauses := _clauses(_walk(parser.parse(pattern), {""}, found)):
        found.append(clauses)
    return found


# ---- index -----------------------------------------------------------------


def _key(df: DataFrame, key: str) -> Column:
    return F.coalesce(df[key].cast("string"), F.lit("null"))


def postings(docs: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """(block, trigram, keys): sorted keys of the documents whose lower-case text holds the trigram; docs: (k, text)."""
    here = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    rows = docs.select("k", F.lower("text").alias("low")).select("k", F.explode(here).alias("trigram"))
    block = F.pmod(F.xxhash64("k"), F.lit(blocks)).alias("block")
    return rows.groupBy(block, "trigram").agg(F.sort_array(F.collect_set("k")).alias("keys"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], blocks: int) -> DataFrame:
    """(k, rules): kinds that a document may hold, from postings; rules without mandatory trigrams are left out."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in asked.values() for clauses in q for s in clauses for t in s})
    lists = postings(docs, trigrams, blocks).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    none = F.array().cast("array<string>")

    def of(trigram: str) -> Column:
        return F.coalesce(F.element_at("lists", trigram), none)

    def hits(query: list[list[frozenset[str]]]) -> Column:
        some = [reduce(F.array_union, [reduce(F.array_intersect, [of(t) for t in sorted(s)]) for s in clauses]) for clauses in query]
        return reduce(F.array_intersect, some)

    def tagged(kind: str, query: list[list[frozenset[str]]]) -> Column:
        return F.transform(hits(query), lambda k: F.struct(k.alias("k"), F.lit(kind).alias("kind")))

    found = F.concat(*[tagged(kind, q) for kind, q in asked.items()])
    return lists.select(F.explode(found).alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.collect_set("x.kind").alias("rules"))


# ---- verification ----------------------------------------------------------


#: Elements of an array that are folded at once.
_FOLDED = 256


def _folded(items: Column, start: Column, empty: Column, step) -> Column:
    """The list that step(acc, item) gathers over an array; acc: struct<at, found>, of which step returns the next.

    Runs of _FOLDED items are folded by themselves, and only their lists are
    appended to the whole, so a very long array is not copied for each item.
    """

    def run(acc: Column, i: Column) -> Column:
        part = F.slice(items, i * _FOLDED + 1, F.lit(_FOLDED))
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("found")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["found"], inner["found"]).alias("found"))

    runs = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _FOLDED).cast("int"))
    whole = F.aggregate(runs, F.struct(start.alias("at"), empty.alias("found")), run, lambda acc: acc["found"])
    return F.when(F.size(items) > 0, whole).otherwise(empty)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, kind, end>> of a rule's matches, left to right, none overlapping; code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    kind = "struct<start:int,rank:int,kind:string,end:int>"

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        size = F.char_length(pair["match"]) if not rule.group else F.char_length(F.regexp_extract(pair["match"], rule.pattern, rule.group))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(size >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match"))
    return _folded(pairs, F.lit(0), F.array().cast(f"array<{kind}>"), step)


def _quick(rule: Rule) -> str:
    """An expression for whether a text can hold a match that is long enough."""
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if rule.group == 0 and re.fullmatch(r"\[[^\]]*\]\+", rule.pattern) else rule.pattern


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's columns and `secret_spans`: array<struct<start, rank, kind, end>>, sorted by start, then the rule's place.

    A null or empty text has none.  Rows of one key are verified each by its own
    text; a null key is a key.  A column of df that is called secret_spans is
    replaced; all others stay.
    """
    df = df.drop("secret_spans")
    blocks = max(64, -(-df.count() // BLOCK_DOCS))
    docs = df.select(_key(df, key).alias("k"), df[text].cast("string").alias("text"))
    found = materialise(candidates(docs, rules, blocks), "candidates")
    # few candidates go to the texts, so that no text is shuffled; many are joined by their keys
    found = checked_broadcast(found, found.count(), 256)
    names = [f"c{i}" for i in range(len(df.columns))]  # so that no column of df has a name that is used here
    at = dict(zip(df.columns, names, strict=True))
    held = df.toDF(*names)
    joined = held.withColumn("k", _key(held, at[key])).join(found, "k", "left")
    body = F.coalesce(F.col(at[text]).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    parts = []
    for rank, rule in enumerate(rules):
        here = F.coalesce(F.array_contains("rules", rule.kind), F.lit(False)) if trigram_query(rule.pattern) else body.rlike(_quick(rule))
        parts.append(F.when(here, spans_of(body, rule, rank)).otherwise(none))
    return joined.select(*names, F.sort_array(F.concat(*parts)).alias("secret_spans")).toDF(*df.columns, "secret_spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_spans) of every row; see find_secrets."""
    spans = F.col("secret_spans")
    out = find_secrets(df.select(key, text), RULES, key, text)
    counts = [F.size(F.filter(spans["kind"], lambda x: x == r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE_RULES]  # noqa: B023  used at once
    base = F.filter(spans, lambda s: s["rank"] < len(BASE_RULES))
    return out.select(key, *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"), F.size(spans).cast("bigint").alias("n_spans"))


def redact(df: DataFrame, mask: str = "[SECRET]", key: str = "doc_id", text: str = "text", size: str | None = None) -> DataFrame:
    """df with each secret (overlapping spans as one) replaced by `mask`; rows without any stay as they are.

    size: a column that gets the new length of a text that was changed.
    """
    def merged(acc: Column, s: Column) -> Column:
        # a span that begins before the last ended adds what it has more, as a gap of none
        start = F.greatest(acc["at"], s["start"])
        one = F.array(F.struct(acc["at"].alias("from"), start.alias("to"), (s["start"] >= acc["at"]).alias("new")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["found"], one).alias("found"))

    found = find_secrets(df, RULES, key, text)
    body, spans = F.col(text), F.col("secret_spans")
    gaps = _folded(spans, F.lit(0), F.array().cast("array<struct<from:int,to:int,new:boolean>>"), merged)
    # of few gaps each is sought in the text; of many, in its characters, as a search starts at the text's first one
    letters = F.split(body, "")
    sought = lambda g: F.substring(body, g["from"] + 1, g["to"] - g["from"])
    sliced = lambda g: F.array_join(F.slice(letters, g["from"] + 1, g["to"] - g["from"]), "")
    masked = lambda of: F.array_join(F.transform(F.filter(gaps, lambda g: g["new"]), lambda g: F.concat(of(g), F.lit(mask))), "")
    rest = F.substring(body, F.array_max(spans["end"]) + 1, F.char_length(body))
    clean = F.concat(F.when(F.size(spans) <= 64, masked(sought)).otherwise(masked(sliced)), rest)
    out = found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body))
    if size:
        out = out.withColumn(size, F.when(F.size("secret_spans") > 0, F.char_length(text).cast(df.schema[size].dataType)).otherwise(F.col(size)))
    return out.drop("secret_spans")


# ---- the same in SQL -------------------------------------------------------


def oracle() -> str:
    """DuckDB SQL for secret_report over documents, with no index: every rule scans every text."""
    ctes, parts = [], []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        ctes.append(f"r{rank} AS (SELECT doc_id, rn, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS g, string_split_regex(text, '{p}') AS p FROM d)")
        ctes.append(f"q{rank} AS (SELECT rn, unnest(range(1, len(m) + 1)) AS k, m, g, p FROM r{rank})")
        ctes.append(
            f"s{rank} AS (SELECT rn, {rank} AS rk, '{r.kind}' AS kind, a AS st, a + length(m[k]) AS en FROM (SELECT *, coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS a FROM q{rank}) WHERE length(g[k]) >= {r.least})"
        )
        parts.append(f"SELECT * FROM s{rank}")
    counts = ", ".join(f"count(s.rn) FILTER (WHERE s.kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    one = "s.kind || ':' || CAST(s.st AS BIGINT) || ':' || CAST(s.en AS BIGINT)"
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents), "
        + ", ".join(ctes)
        + ", s AS ("
        + " UNION ALL ".join(parts)
        + f") SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY s.st, s.rk) FILTER (WHERE s.rk < {len(BASE_RULES)}), '')) AS base_sha256, "
        + f"coalesce(string_agg({one}, ',' ORDER BY s.st, s.rk), '') AS spans, count(s.rn) AS n_spans FROM d LEFT JOIN s ON s.rn = d.rn GROUP BY d.rn, d.doc_id"
    )
