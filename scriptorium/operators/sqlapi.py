"""Bounded, read-only SQL over registered views."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and characters of a value that a result holds at most, and seconds that it may take.
MOST_ROWS, MOST_CHARS, MOST_SECONDS = 100, 5000, 30.0

#: Functions that a statement may call; none of them reaches outside the query's rows.
FUNCTIONS = frozenset(
    """
    abs acos any any_value approx_count_distinct array array_agg array_contains array_distinct array_except array_intersect array_join array_max array_min array_position
    array_size array_sort array_union arrays_overlap asin atan avg base64 between bool_and bool_or bround cast ceil ceiling char_length coalesce collect_list collect_set concat
    concat_ws contains corr cos count count_if cume_dist date date_add date_diff date_format date_sub date_trunc day dayofweek dense_rank element_at endswith every exists exp
    explode explode_outer filter first first_value flatten floor format_number from_json from_unixtime get get_json_object greatest hash hex hour if ifnull in initcap instr isnan
    isnotnull isnull json_array_length json_object_keys kurtosis lag last last_day last_value lcase lead least left length levenshtein like ln locate log log10 log2 lower lpad
    ltrim map map_keys map_values max max_by md5 mean median min min_by minute mod month monotonically_increasing_id named_struct not nth_value ntile nullif nvl nvl2 parse_json
    percent_rank percentile percentile_approx pmod posexplode position pow power quarter rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace regr_slope
    repeat replace reverse right rlike round row_number rpad rtrim second sequence sha1 sha2 sign sin size skewness slice some sort_array soundex split split_part sqrt startswith
    std stddev stddev_pop stddev_samp string struct substr substring substring_index sum tan timestamp to_date to_json to_timestamp transform translate trim trunc try_cast
    try_divide try_parse_json try_variant_get ucase unix_timestamp upper var_pop var_samp variance weekofyear when xxhash64 year zip_with
    """.split()
)


class NotReadOnly(ValueError):
    """The statement is no plain query of registered views with allowed functions."""


class TooLong(RuntimeError):
    """The statement was stopped at its deadline."""


def _nodes(x: object, gateway) -> Iterator[JavaObject]:
    """All parts of a parsed plan: operators, expressions, the plans of subqueries and of WITH."""
    if not isinstance(x, JavaObject):
        return
    if is_instance_of(gateway, x, "scala.collection.Iterable"):
        it = x.iterator()
    elif is_instance_of(gateway, x, "scala.Product"):
        yield x
        it = x.productIterator()
    else:
        return
    while it.hasNext():
        yield from _nodes(it.next(), gateway)


#: Parts of a parsed plan that are no plain query: what reads files, runs scripts, or makes rows from code.
_REFUSED = ("ScriptTransformation", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedTable", "UnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier", "LateralJoin")


def checked(spark: SparkSession, sql: str) -> None:
    """Raises NotReadOnly unless `sql` is one query over temporary views with functions of FUNCTIONS."""
    if not sql.lstrip().lower().startswith(("select", "with")):
        raise NotReadOnly("only SELECT is allowed")
    gateway = spark.sparkContext._gateway
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    parts = list(_nodes(plan, gateway))
    for x in parts:
        if x.getClass().getName().startswith("scala.Tuple") and isinstance(x._1(), str):  # a name that WITH defines
            views.add(x._1().lower())
    for x in parts:
        kind = x.getClass().getSimpleName()
        if kind in _REFUSED or is_instance_of(gateway, x, "org.apache.spark.sql.catalyst.plans.logical.Command") or kind.startswith(("Insert", "Create", "Drop", "Replace", "Delete", "Update", "Merge")):
            raise NotReadOnly(kind)
        if kind == "UnresolvedRelation":
            name = x.multipartIdentifier().mkString(".")
            if name.lower() not in views:
                raise NotReadOnly(f"relation {name}")
        if kind == "UnresolvedFunction":
            name = x.nameParts().mkString(".").lower()
            if name not in FUNCTIONS:
                raise NotReadOnly(f"function {name}")


def query(spark: SparkSession, sql: str, limit: int = MOST_ROWS, seconds: float = MOST_SECONDS, **args) -> tuple[list[dict], bool]:
    """(rows, truncated) of a SELECT with named parameters.

    The statement is parsed by Spark, and passes only if all its relations are
    temporary views (or names of its WITH) and all its functions are listed; so
    commands, files, other catalogs and calls of code are refused whatever they
    are spelled like.  At the deadline its jobs are cancelled.
    """
    checked(spark, sql)
    limit = max(1, min(limit, MOST_ROWS))
    out: DataFrame = spark.sql(sql, args=args)
    kept = [F.substring(F.col(f"`{f.name}`"), 1, MOST_CHARS).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in out.schema.fields]
    tag, late = f"bounded-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(tag, "bounded query", True)
    timer.start()
    try:
        rows = out.select(*kept).limit(limit + 1).collect()
    except (PySparkException, Py4JError) as e:
        if late.is_set():
            raise TooLong(f"over {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return [r.asDict() for r in rows[:limit]], len(rows) > limit
