"""Keeping derived tables in step with their sources, and the rules of a review workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reasons of quarantine that hold rules, all that are known, and flags of layouts that need a review
RULE_BEARING = ("unresolved-table", "unbound-layout", "heading-artifact", "unresolved-continuation", "unresolved-layout", "layout-order-conflict", "oversize-block", "other")
REASONS = RULE_BEARING[:-1] + ("repeated-furniture", "page-number", "contents-index", "credits-legal", "printed-page-number-v1", "repeated-margin-furniture-v1", "watermark-email-span-v1", "watermark-identity-row-v1")
COMPLEX_LAYOUT = (
    "unclassified-native-coverage", "complex-layout", "table-ambiguous", "table-cell", "layout-model-complex", "layout-model-table", "layout-model-unbound",
    "layout-order-conflict", "layout-region-split", "unsupported-layout", "unresolved-continuation", "heading-artifact", "oversize-block",
)


def sync_plan(old: DataFrame, new: DataFrame, key: str, content: str, meta: str) -> DataFrame:
    """(key, action): what a sync does with each row: add, replace (its content changed), touch (only its metadata did), keep or remove.

    Only rows to add or replace need to be embedded anew.
    """
    o = old.select(key, F.col(content).alias("_oc"), F.col(meta).alias("_om"), F.lit(True).alias("_o"))
    n = new.select(key, F.col(content).alias("_nc"), F.col(meta).alias("_nm"), F.lit(True).alias("_n"))
    action = F.when(F.col("_o").isNull(), "add").when(F.col("_n").isNull(), "remove").when(~F.col("_oc").eqNullSafe(F.col("_nc")), "replace").when(~F.col("_om").eqNullSafe(F.col("_nm")), "touch").otherwise("keep")
    return o.join(n, key, "full_outer").select(key, action.alias("action"))


def sync_counts(plan: DataFrame) -> DataFrame:
    """One row (active, changed, removed, unchanged) of a plan; metadata alone does not count as a change."""
    some = lambda *names: F.count(F.when(F.col("action").isin(*names), 1))
    return plan.agg(some("add", "replace", "touch", "keep").alias("active"), some("add", "replace").alias("changed"), some("remove").alias("removed"), some("touch", "keep").alias("unchanged"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The snapshot after an upsert: new rows, and the old ones of other keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_entries(df: DataFrame, bases: DataFrame, key: str, origin: str | None = None, of: str = "origin") -> DataFrame:
    """df without the entries of these base ids and their pages, `<base>_page_<any>`, of one origin if told."""
    # an id may itself hold `_page_`: every beginning before one can be the base
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split(F.col(key), "_page_", -1))), lambda i: F.array_join(F.slice(F.split(F.col(key), "_page_", -1), 1, i), "_page_"))
    names = df.select(key, F.explode(heads).alias("_base")).distinct()
    gone = names.join(bases.select(F.col(bases.columns[0]).alias("_base")).distinct(), "_base", "left_semi").select(key).distinct()
    held = df.withColumn("_gone", F.lit(True) if origin is None else F.col(of) == origin)
    marked = held.join(gone.withColumn("_hit", F.lit(True)), key, "left")
    return marked.filter(~(F.coalesce(F.col("_hit"), F.lit(False)) & F.coalesce(F.col("_gone"), F.lit(False)))).drop("_hit", "_gone")


def tombstones(before: DataFrame, ids: DataFrame, bare: str) -> DataFrame:
    """Bare ids that more than one row has, or once had: the set only grows."""
    now = ids.groupBy(bare).agg(F.count("*").alias("_n")).filter("_n > 1").select(bare)
    return before.select(bare).union(now).distinct()


def set_differences(expected: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """One row (missing, extra, repeated): all zero if every expected key is owned exactly once."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(1))
    o = owned.groupBy(key).agg(F.count("*").alias("_n"))
    j = e.join(o, key, "full_outer")
    return j.agg(F.count(F.when(F.col("_n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_e").isNull(), 1)).alias("extra"), F.count(F.when(F.col("_n") > 1, 1)).alias("repeated"))


def unmet(required: DataFrame, rows: DataFrame, key: str, same: list[str], hashes: list[str]) -> DataFrame:
    """(key, problem) of required rows that are not there, differ in one of `same`, or have none of the rows' hashes as `hash`."""
    held = rows.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_r_{c}") for c in same], F.array(*hashes).alias("_hashes"))
    j = required.join(held, required[key] == held["_key"], "left")
    problem = F.when(F.col("_key").isNull(), "missing")
    for c in same:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), c)
    problem = problem.when(~F.coalesce(F.array_contains("_hashes", F.col("hash")), F.lit(False)), "hash")
    return j.select(key, problem.alias("problem")).filter("problem is not null")


def merged_translations(entries: DataFrame, told: DataFrame, name: str) -> DataFrame:
    """entries with `translated_name` and `translated_text` by their exact name; null where there is none."""
    return entries.join(told.groupBy(name).agg(F.max_by(F.struct("translated_name", "translated_text"), "ordinal").alias("_t")), name, "left").select(entries["*"], "_t.translated_name", "_t.translated_text")


def pack_map(packs: list[str], translated: list[str]) -> dict[str, str]:
    """Packs to their translations: by name without prefixes and `-srd`, then by what is left without hyphens, then by a part of more than eight letters.

    Lists of names are as short as the number of packs; each pack gets one.
    """
    def bare(name: str) -> str:
        return name.removeprefix("pf2e.").removeprefix("pf2e-")

    def plain(name: str) -> str:
        return name.replace("-", "").replace("_", "").lower()

    out: dict[str, str] = {}
    for name in translated:
        for candidate in dict.fromkeys((bare(name), bare(name).removesuffix("-srd"))):
            if candidate in packs:
                out[candidate] = name
    for name in (n for n in translated if n not in out.values()):
        want = plain(bare(name))
        hit = next((p for p in packs if p not in out and (plain(p) == want or (len(want) > 8 and want in plain(p)))), None)
        if hit is not None:
            out[hit] = name
    return out


def known_reason(reason: Column) -> Column:
    return F.when(reason.isin(*REASONS), reason).otherwise("other")


def coverage_problem(status: Column, coverage: Column, chosen: Column, supplied: Column) -> Column:
    """What is wrong with a coverage judgement, or null."""
    none = F.size(chosen) == 0
    return (
        F.when(F.size(F.array_except(chosen, supplied)) > 0, "unsupplied")
        .when(status != "valid", F.when((coverage != "not-applicable") | ~none, "judged invalid input"))
        .when(coverage == "not-applicable", "not judged")
        .when((coverage == "covered") & none, "covered by nothing")
        .when((coverage != "covered") & ~none, "chosen but not covered")
    )


def layout_problem(decision: Column, flags: Column, tags: Column) -> Column:
    """What is wrong with a decision on a section of that layout, or null."""
    hard = F.arrays_overlap(flags, F.array(*map(F.lit, COMPLEX_LAYOUT)))
    return F.when((decision == "PUBLIC_AS_IS") & hard, "complex layout").when((decision == "MIXED_NEEDS_EXTRACTION") & ~F.array_contains(tags, "layout-reviewed"), "layout not reviewed")


def current_leases(events: DataFrame, key: str, worker: str, at: str, seconds: int, now: Column) -> DataFrame:
    """(key, worker, expires) of the lease that each key's claims have led to by `now`.

    A claim counts if no lease of another worker runs at its time; the holder's own claim renews it.
    """
    claims = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(worker).cast("string").alias("who"))))
    start = F.struct(F.lit(None).cast("string").alias("who"), F.lit(0).cast("bigint").alias("until"))

    def step(s: Column, c: Column) -> Column:
        free = s["who"].isNull() | (s["until"] < c["at"]) | (s["who"] == c["who"])
        return F.struct(F.when(free, c["who"]).otherwise(s["who"]).alias("who"), F.when(free, c["at"] + seconds).otherwise(s["until"]).alias("until"))

    held = events.groupBy(key).agg(F.aggregate(claims, start, step).alias("s"))
    return held.select(key, F.col("s.who").alias(worker), F.col("s.until").alias("expires")).filter(F.col("expires") >= now)


def disjoint(candidates: DataFrame, group: str, ident: str, keys: str, width: str, offset: str) -> DataFrame:
    """(group, ident) of the candidates that stay: taken by width, offset and id, each that shares no key with one taken before.

    A group is one document's proposals.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col(width).alias("w"), F.col(offset).alias("o"), F.col(ident).alias("id"), F.col(keys).alias("keys"))))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<{dict(candidates.dtypes)[ident]}>").alias("kept"))

    def step(s: Column, c: Column) -> Column:
        free = ~F.arrays_overlap(s["used"], c["keys"])
        return F.struct(F.when(free, F.concat(s["used"], c["keys"])).otherwise(s["used"]).alias("used"), F.when(free, F.concat(s["kept"], F.array(c["id"]))).otherwise(s["kept"]).alias("kept"))

    return candidates.groupBy(group).agg(F.aggregate(order, start, step, lambda s: s["kept"]).alias("kept")).select(group, F.explode("kept").alias(ident))


def latest(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_n = 1").drop("_n")
