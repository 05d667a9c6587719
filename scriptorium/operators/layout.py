"""Lines of pages: headings, furniture, reading order, conflicts, and sections cut to a length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of fonts that are bold or icons, titles and roles of pages that hold no rules
BOLD = ("bold", "semibold", "heavy", "black", "display", "condbold")
ICONS = ("pathfinder-icons", "taroca")
CONTENTS = ("contents", "table of contents", "index", "subject index")
LEGAL = ("credits", "open game license version 1 0a", "orc notice", "orc license", "product identity", "designation of product identity")
ROLES = ("authors", "designers", "developers", "editors", "art director")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def is_heading(text: Column, size: Column, fonts: Column, body: Column, strict: bool = True, upper: Callable[[Column], Column] = F.upper) -> Column:
    """Whether a line is a heading by its type: much larger than the body, mostly bold and larger, or capitals.

    strict: capitals count only where they are bold and display-sized too; upper:
    what makes capitals of a text.
    """
    holds = lambda names: lambda f: F.lower(f).rlike("|".join(names))
    n = F.greatest(F.size(fonts), F.lit(1))
    bold = F.size(F.filter(fonts, holds(BOLD))) / n
    icons = (F.size(fonts) > 0) & (F.size(F.filter(fonts, holds(ICONS))) == F.size(fonts))
    caps = (upper(text) == text) & text.rlike(r"\p{L}") & (F.char_length(text) < 90)
    caps = caps & (bold >= 0.8) & (size >= body + 1.5) if strict else caps & (size >= body)
    usable = (F.char_length(text) <= 160) & ~text.rlike(EMAIL) & (F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= 3) & ~icons
    return usable & ((size >= body + 2.5) | ((bold >= 0.8) & (size >= body + 0.75)) | caps)


def page_kind(page: Column, lines: Column) -> Column:
    """contents-index, credits-legal or null for a page, by its lines."""
    normal = F.transform(lines, lambda x: F.array_join(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "))
    titled = F.arrays_overlap(normal, F.array(*map(F.lit, CONTENTS)))
    leaders = F.size(F.filter(lines, lambda x: x.rlike(r"(?:\.{2,}|\s)\d{1,4}\s*$")))
    listed = (F.size(lines) >= 8) & (leaders >= F.greatest(F.lit(5), F.floor(F.size(lines) / 3)))
    legal = F.exists(normal, lambda x: x.rlike("|".join(LEGAL)))
    roles = F.size(F.filter(normal, lambda x: x.rlike("|".join(ROLES))))
    return F.when(titled | listed, "contents-index").when(legal | ((page <= 12) & (roles >= 3)), "credits-legal")


def furniture(lines: DataFrame, page: str, text: str, top: str, bottom: str, height: str) -> DataFrame:
    """(line, pages): lines without their numbers that stand in the upper or lower eighth of two pages or more."""
    band = (F.col(top) < F.col(height) * 0.12) | (F.col(bottom) > F.col(height) * 0.88)
    plain = F.array_join(F.regexp_extract_all(F.lower(F.regexp_replace(text, r"\b\d+\b", "")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    held = lines.filter(band).select(page, plain.alias("line")).filter("line <> ''").distinct()
    return held.groupBy("line").agg(F.count("*").alias("pages")).filter("pages >= 2")


def reading_order(lines: DataFrame, page: str, gutter: Column, spans: Column, top: str, x0: str, x1: str, key: str) -> DataFrame:
    """Adds `place`: two columns are read one after the other between the blocks that span both."""
    by_top = Window.partitionBy(page).orderBy(top, x0, key)
    held = lines.withColumn("_span", spans).withColumn("_band", F.sum(F.col("_span").cast("int")).over(by_top))
    # a spanning block opens its band, so it comes before what stands under it
    side = F.when(F.col("_span"), 0).when((F.col(x0) + F.col(x1)) / 2 < gutter, 1).otherwise(2)
    return held.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("_band", side, top, x0, key))).drop("_span", "_band")


def order_conflicts(regions: DataFrame, page: str, order: str) -> DataFrame:
    """(page, order) of neighbours of which the later starts above the earlier, where they stand over each other; regions: x0, x1, top."""
    w = Window.partitionBy(page).orderBy(order)
    shared = lambda x0, x1: F.greatest(F.lit(0.0), F.least(F.col("x1"), x1) - F.greatest(F.col("x0"), x0)) / F.least(F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(1.0), x1 - x0))
    next_, last = {c: F.lead(c).over(w) for c in ("x0", "x1", "top")}, {c: F.lag(c).over(w) for c in ("x0", "x1", "top")}
    before = (shared(next_["x0"], next_["x1"]) >= 0.5) & (next_["top"] + 2 < F.col("top"))
    after = (shared(last["x0"], last["x1"]) >= 0.5) & (F.col("top") + 2 < last["top"])
    return regions.withColumn("_c", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).filter("_c").select(page, order)


def split_regions(owners: DataFrame, region: str, section: str) -> DataFrame:
    """Regions whose anchors lie in two or three sections in a row."""
    got = owners.groupBy(region).agg(F.countDistinct(section).alias("sections"), F.min(section).alias("_a"), F.max(section).alias("_b"))
    return got.filter("sections between 2 and 3 and _b - _a = sections - 1").select(region, "sections")


def cut_sections(blocks: DataFrame, key: str, order: str, size: str, heading: str, most: int = 7800, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, order, part): a section's blocks in parts of at most `most` characters, of which none ends with its heading alone.

    A section is one heading's blocks; they are folded in order: by the columns
    `by`, if there are any, as `order` may be a number that these outgrow.
    """
    listed = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(by)], F.col(order).alias("o"), F.col(size).cast("double").alias("n"), F.col(heading).alias("h"))))
    start = F.struct(F.lit(0).alias("part"), F.lit(0.0).alias("held"), F.lit(False).alias("some"), F.lit(False).alias("body"), F.array().cast(f"array<struct<o:{dict(blocks.dtypes)[order]},part:int>>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        full = s["some"] & (s["held"] + b["n"] + 1 > most) & s["body"]
        part = s["part"] + full.cast("int")
        held = F.when(full | ~s["some"], b["n"]).otherwise(s["held"] + b["n"] + 1)
        body = F.when(full, ~b["h"]).otherwise(s["body"] | ~b["h"])
        return F.struct(part.alias("part"), held.alias("held"), F.lit(True).alias("some"), body.alias("body"), F.concat(s["out"], F.array(F.struct(b["o"].alias("o"), part.alias("part")))).alias("out"))

    got = blocks.groupBy(key).agg(F.aggregate(listed, start, step, lambda s: s["out"]).alias("x"))
    return got.select(key, F.explode("x").alias("x")).select(key, F.col("x.o").alias(order), F.col("x.part").alias("part"))


def clean_text(text: Column) -> Column:
    """Text without addresses and double blanks; one of each two words where three in four pairs are the same word twice."""
    x = F.trim(F.regexp_replace(F.regexp_replace(text, EMAIL, ""), r"(?U)\s+", " "))
    words = F.split(x, " ")
    even = F.filter(words, lambda _, i: i % 2 == 0)
    same = F.size(F.filter(F.zip_with(even, F.filter(words, lambda _, i: i % 2 == 1), lambda a, b: F.lower(a) == F.lower(b)), lambda b: b))
    twice = (F.size(words) >= 2) & (F.size(words) % 2 == 0) & (same / (F.size(words) / 2) >= 0.75)
    return F.when(twice, F.array_join(even, " ")).otherwise(x)


def stable_identities(sections: DataFrame, parts: list[str], apart: Column) -> DataFrame:
    """Adds `identity`: the digest of some columns; rows that share one get another, of it and of what tells them apart."""
    base = F.sha2(F.concat_ws("\n", F.lit("section-identity-v2"), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    held = sections.withColumn("_base", base)
    shared = F.count("*").over(Window.partitionBy("_base")) > 1
    return held.withColumn("identity", F.when(shared, F.sha2(F.concat_ws("\n", F.lit("collision-1"), "_base", apart), 256)).otherwise(F.col("_base"))).drop("_base")
