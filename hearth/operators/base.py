"""Helpers shared by the operators: top-k, numbering, spines, matching by bands and by contained text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from ..functions.money import idiv
from ..sources.scratch import written


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key. Spark cuts to k inside every task before the shuffle, so a hot key stays small."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def numbered(df: DataFrame, keys: list[str], part: str, row_id: str, name: str, width: int = 1 << 20) -> DataFrame:
    """1, 2, 3 ... per key in (part, row_id) order without ever sorting one whole key in one task.

    The ids of a key and part, dense or hashed, are cut into as many equal ranges as it has `width` rows. Rows are numbered inside their
    range; the start of each range is a running count over the few ranges of the key.
    """
    at = F.col(row_id).cast("double")
    spread = df.groupBy(*keys, part).agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.ceil(F.count("*") / width).alias("_ranges"))
    place = F.floor((at - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * F.col("_ranges"))
    ranged = df.join(spread, [*keys, part]).withColumn("_range", place).drop("_low", "_high", "_ranges")
    starts = (
        ranged.groupBy(*keys, part, "_range").agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(W.partitionBy(*keys).orderBy(part, "_range").rowsBetween(W.unboundedPreceding, -1)),
        )
        .select(*keys, part, "_range", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(W.partitionBy(*keys, part, "_range").orderBy(row_id))
    return (
        ranged.withColumn("_in", inside).join(starts, [*keys, part, "_range"])
        .withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_before", "_in")
    )


def month_spine(df: DataFrame, first: Column | int, last: Column | int, name: str = "month_index") -> DataFrame:
    """One row per month from first to last for every row of df (keep df small: one row per household)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumn(name, F.explode(F.sequence(lit(first), lit(last)))).withColumn(name, F.col(name).cast("int"))


# ---- bands ---------------------------------------------------------------------------------------------
def near_cents(c: Column | str, width: int = 1) -> Column:
    """Array of the amounts within `width` cents; explode it to turn 'equal within a cent' into an equi-join."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sequence(c - F.lit(width), c + F.lit(width))


def islands(df: DataFrame, keys: list[str], value: str, reach: int, name: str = "island") -> DataFrame:
    """df with `name`: a number per key for the values that are joined by steps of `reach` or less.

    Rows whose values are never more than `reach` apart lie in one island, so what belongs together is never cut. Only distinct values are sorted.
    """
    line = W.partitionBy(*keys).orderBy(value)
    seen = df.select(*keys, value).distinct().withColumn("_new", F.coalesce(F.col(value) - F.lag(value).over(line) > reach, F.lit(True)).cast("int"))
    return df.join(seen.withColumn(name, F.sum("_new").over(line)).drop("_new"), [*keys, value])


# ---- contained text ------------------------------------------------------------------------------------
GRAM = 4


def _pieces(text: Column, width: Column) -> Column:
    """The distinct pieces of `width` characters of a text that is long enough."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.substring(text, i, width)))


def contains_join(
    long: DataFrame, short: DataFrame, keys: list[str], long_col: str, short_col: str
) -> DataFrame:
    """Pairs (row of long, row of short) with the same keys where short_col is part of long_col.

    An inverted index: the pieces of GRAM characters of the long texts (shorter ones where a short text is shorter) point to them. A short text is looked
    up under its rarest piece, and under none if one of its pieces stands nowhere, so what meets is little more than what fits, and no
    household is paired off with itself. Give both sides distinct texts.
    """
    marked = written(short.filter(F.length(short_col) > 0).withColumn("_len", F.least(F.length(short_col), F.lit(GRAM))))
    lengths = marked.select(*keys, "_len").distinct()  # GRAM rows a key at most
    pieces = long.join(lengths.hint("merge"), keys).filter(F.length(long_col) >= F.col("_len"))
    pieces = written(pieces.withColumn("_gram", F.explode(_pieces(F.col(long_col), F.col("_len")))).drop("_len"))
    held = pieces.groupBy(*keys, "_gram").agg(F.count("*").alias("_held"))
    own = [c for c in marked.columns if c != "_len"]
    asked = marked.withColumn("_gram", F.explode(_pieces(F.col(short_col), F.col("_len")))).join(held.hint("merge"), [*keys, "_gram"], "left")
    rarest = asked.groupBy(*own).agg(F.min_by("_gram", F.struct("_held", "_gram")).alias("_gram"), F.count_if(F.col("_held").isNull()).alias("_lacking"))
    rarest = rarest.filter("_lacking = 0").drop("_lacking")
    # The pieces are many times the texts, and few bytes in their files: they are merged, never sent through the driver.
    return pieces.join(rarest.hint("merge"), [*keys, "_gram"]).filter(F.col(long_col).contains(F.col(short_col))).drop("_gram")


# ---- folds in order ------------------------------------------------------------------------------------
def sorted_fold(
    df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Callable], schema: T.StructType
) -> DataFrame:
    """Fold the rows of every key in order.

    The rows are hash-partitioned by key and sorted in Spark; the task streams Arrow batches and keeps only the
    state of the key it is in, so a long key needs no more memory than its state.  `make()` gives a fresh object
    with `row(r) -> iterable of output tuples` and `end() -> iterable of output tuples`.
    """
    out_schema = to_arrow_schema(schema)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold = None, None

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, out_schema)], names=names
            )

        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    if fold is not None:
                        out.extend(current + tuple(r) for r in fold.end())
                    current, fold = key, make()
                out.extend(current + tuple(r) for r in fold.row(row))
            if out:
                yield pack(out)
        if fold is not None:
            last = [current + tuple(r) for r in fold.end()]
            if last:
                yield pack(last)

    ready = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ready.mapInArrow(run, schema)


def month_of(year: int, month: int) -> int:
    return year * 12 + month - 1


def session_defaults(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the jobs rely on: adaptive plans, skew splitting and UTC days."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
