"""A user's own SELECT over named tables of a video: the log, identities, tracks, series, meta.

The text is judged by its plan, never by its words. What Spark's parser makes of it may hold only the relational nodes, the
given tables and common table expressions, and the functions named here; commands, files as tables, other tables, table
functions, several statements and names made at run time have other nodes or names and are refused. The analysed plan is
judged again: below the given tables nothing is looked at, all other leaves must be literal rows, and no expression may call
code. The text itself is never rewritten, so literals stay as they are; it sees its tables as common table expressions in
front of it and leaves no view behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

# What a text may hold. Nodes of parsed plans, unresolved expressions, functions.
NODES = frozenset(
    "UnresolvedWith SubqueryAlias UnresolvedSubqueryColumnAliases Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Join "
    "Union Intersect Except Distinct Generate LateralJoin WithWindowDefinition UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation Pivot Unpivot".split()
)
UNRESOLVED = frozenset("UnresolvedAlias UnresolvedFunction UnresolvedGenerator UnresolvedAttribute UnresolvedStar UnresolvedOrdinal UnresolvedExtractValue UnresolvedStarExceptOrReplace MultiAlias".split())
FUNCTIONS = frozenset(
    "abs acos any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position array_remove array_sort array_union asin atan atan2 avg bool_and bool_or "
    "cardinality cbrt ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if cume_dist dense_rank element_at endswith every exists exp explode explode_outer "
    "filter first first_value flatten floor fmt format_number format_string forall greatest hypot if ifnull initcap instr isnan isnotnull isnull kurtosis lag last last_value lcase lead least left length levenshtein like ln locate log log10 lower lpad ltrim "
    "max max_by mean median min min_by mod mode named_struct nanvl negative nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx percentile_cont pmod posexplode position pow power "
    "rank regexp_count regexp_extract regexp_like regexp_replace repeat replace reverse right rint rlike round row_number rpad rtrim sequence sign sin size skewness slice some sort_array split sqrt "
    "startswith std stddev stddev_pop stddev_samp struct substr substring sum tan transform trim try_divide ucase upper var_pop var_samp variance when".split()
)
#: Expressions that run code or tell of the session, in case an allowed name has been given a meaning of its own.
BARRED = frozenset("CallMethodViaReflection TryReflect PythonUDF PythonUDAF PythonUDTF ScalaUDF ScalaAggregator ScalaUDAF HiveSimpleUDF HiveGenericUDF HiveUDAFFunction VariableReference CurrentUser InputFileName InputFileBlockStart InputFileBlockLength".split())
ROWS = frozenset("OneRowRelation LocalRelation CTERelationRef UnionLoopRef ResolvedInlineTable".split())

FMT = """CREATE OR REPLACE TEMPORARY FUNCTION fmt(seconds DOUBLE) RETURNS STRING RETURN
CASE WHEN seconds IS NULL THEN '—' ELSE concat(
  CASE WHEN round(greatest(seconds, 0D) * 10) >= 36000 THEN concat(CAST(floor(round(greatest(seconds, 0D) * 10) / 36000) AS STRING), ':', lpad(CAST(floor(round(greatest(seconds, 0D) * 10) / 600) % 60 AS STRING), 2, '0'))
       ELSE CAST(floor(round(greatest(seconds, 0D) * 10) / 600) AS STRING) END,
  ':', lpad(CAST(floor(round(greatest(seconds, 0D) * 10) / 10) % 60 AS STRING), 2, '0'), '.', CAST(CAST(round(greatest(seconds, 0D) * 10) AS BIGINT) % 10 AS STRING)) END"""


class Refused(ValueError):
    """The text is no single SELECT over the given tables with the functions of this module."""


def register(spark: SparkSession) -> None:
    """fmt(seconds) as a function of the session's SQL: m:ss.s or h:mm:ss.s, a dash for null."""
    spark.sql(FMT)


def _all(found) -> Iterator:
    return (found.apply(i) for i in range(found.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _nodes(plan) -> Iterator:
    """A plan's nodes, those of subqueries and common table expressions among them."""
    yield plan
    for inner in (*_all(plan.children()), *_all(plan.innerChildren())):
        yield from _nodes(inner)


def _parts(expression) -> Iterator:
    yield expression
    for inner in _all(expression.children()):
        yield from _parts(inner)


def _written(plan, tables: set[str]) -> None:
    """Refuses a parsed plan that holds anything but allowed nodes, names and functions."""
    nodes = list(_nodes(plan))
    own = {rel._1() for n in nodes if _kind(n) == "UnresolvedWith" for rel in _all(n.cteRelations())}
    known = {name.lower() for name in (*tables, *own)}
    for node in nodes:
        kind = _kind(node)
        if kind not in NODES:
            raise Refused(f"{kind} is not part of a plain SELECT")
        if kind == "UnresolvedRelation":
            name = list(_all(node.multipartIdentifier()))
            if len(name) != 1 or name[0].lower() not in known:
                raise Refused(f"{'.'.join(name)} is none of the tables {', '.join(sorted(tables))}")
        for e in (p for e in _all(node.expressions()) for p in _parts(e)):
            kind, package = _kind(e), e.getClass().getPackageName()
            if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
                name = list(_all(e.nameParts())) if kind == "UnresolvedFunction" else [e.name().unquotedString()]
                if len(name) != 1 or name[0].lower() not in FUNCTIONS:
                    raise Refused(f"the function {'.'.join(name)} is not allowed")
            elif kind not in UNRESOLVED and not package.startswith("org.apache.spark.sql.catalyst.expressions"):
                raise Refused(f"{kind} is not allowed")


def _meant(plan, mark: str) -> None:
    """Refuses an analysed plan that reads or runs anything outside the given tables, whose aliases begin with mark."""
    if _kind(plan) == "SubqueryAlias" and plan.alias().startswith(mark):
        return
    inner = [*_all(plan.children()), *_all(plan.subqueries())]
    if not inner and _kind(plan) not in ROWS:
        raise Refused(f"{_kind(plan)} is none of the given tables")
    for e in (p for e in _all(plan.expressions()) for p in _parts(e)):
        if _kind(e) in BARRED:
            raise Refused(f"{_kind(e)} is not allowed")
    for x in inner:
        _meant(x, mark)


def select(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """The rows of a user's SELECT; Refused if it is anything else."""
    spark = next(iter(tables.values())).sparkSession
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as wrong:
        raise Refused(f"not one SELECT: {wrong}") from None
    _written(parsed, set(tables))
    register(spark)
    mark = f"_given_{uuid.uuid4().hex}_"
    given = {name: f"{mark}{name}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(given[name])
    try:
        front = ", ".join(f"`{name}` AS (SELECT * FROM `{view}`)" for name, view in given.items())
        found = spark.sql(f"WITH {front} SELECT * FROM (\n{text.rstrip().rstrip(';')}\n)")
    except ParseException as wrong:
        raise Refused(f"not one SELECT: {wrong}") from None
    finally:
        for view in given.values():
            spark.catalog.dropTempView(view)
    _meant(found._jdf.queryExecution().analyzed(), mark)
    return found
