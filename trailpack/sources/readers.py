"""Feed readers with a row-level split into good and rejected records.

JSON is read as text and cast column by column. A value that does not fit rejects its own record;
with typed JSON columns it would be nulled silently, or take a whole JSON array down with it. Days and
times stay text in the raw schemas; one that does not parse rejects its record too, in every layout. A
missing or null one does not: it is counted as undated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import day_of_text, lenient_cast
from ..schemas import atc_schema, clicks_schema, impressions_schema, orders_schema
from .arrays import array_elements

LAYOUTS = ("lines", "array", "parquet")
CORRUPT = "_corrupt_record"
BAD_FIELDS = "_bad_fields"


# The day or time columns that the operators read, with how they read them.
TIMES = {
    "as_of_date": lambda c: lenient_cast(c, "date"),
    "dt": day_of_text,
    "order_date": lambda c: lenient_cast(c, "date"),
    "click_time": lambda c: lenient_cast(c, "timestamp"),
    "occurred_at": lambda c: lenient_cast(c, "timestamp"),
}
FEED_TIMES = {
    "impressions": ("dt",),
    "clicks": ("click_time",),
    "atc": ("occurred_at",),
    "orders": ("order_date",),
}

def _as_text(dtype: T.DataType) -> T.DataType:
    """The same nesting with every leaf a string."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_as_text(dtype.elementType))
    return T.StringType()


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType))


def _typed(text: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        # Only the JSON words; a cast would take 1, t or yes as well.
        return F.when(text.isin("true", "false"), text.cast("boolean"))
    if isinstance(dtype, T.StructType):
        fields = [_typed(text[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(text.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(text, lambda x: _typed(x, dtype.elementType))
    return text if isinstance(dtype, T.StringType) else text.try_cast(dtype)


def _misfit(text: Column, dtype: T.DataType) -> Column:
    """True where some leaf has a value that its type cannot hold."""
    if isinstance(dtype, T.StructType):
        misfit = F.lit(False)
        for f in dtype.fields:
            misfit = misfit | _misfit(text[f.name], f.dataType)
        return F.coalesce(misfit, F.lit(False))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(text, lambda x: _misfit(x, dtype.elementType)), F.lit(False))
    if isinstance(dtype, T.StringType):
        return F.lit(False)
    return text.isNotNull() & _typed(text, dtype).isNull()


def flag_rejects(
    raw: DataFrame,
    schema: T.StructType,
    corrupt_col: str | None = None,
    times: tuple[str, ...] = (),
) -> DataFrame:
    """Type a table of text columns, naming in ``_bad_fields`` what did not fit.

    ``times`` names the text columns that must parse as a day or time where they are not null. Nested columns arrive as JSON text. Adds the raw record as ``_raw`` (null for good rows, so it
    costs nothing at rest).
    """
    parsed, bad = {}, []
    for f in schema.fields:
        text = F.col(f"raw.{f.name}")
        if _is_nested(f.dataType):
            parsed[f.name] = F.from_json(text, _as_text(f.dataType))
            wrong = _misfit(F.col(f"text.{f.name}"), f.dataType) | (
                text.isNotNull() & F.col(f"text.{f.name}").isNull()
            )
        else:
            parsed[f.name] = text
            wrong = _misfit(F.col(f"text.{f.name}"), f.dataType)
            if f.name in times:
                wrong = wrong | unparseable(text, f.name)
        bad.append(F.when(wrong, F.lit(f.name)))
    if corrupt_col:
        bad.append(F.when(F.col(f"raw.{corrupt_col}").isNotNull(), F.lit(corrupt_col)))

    staged = (
        raw.select(F.struct("*").alias("raw"))
        .withColumn("text", F.struct(*[c.alias(name) for name, c in parsed.items()]))
        .withColumn(BAD_FIELDS, F.array_compact(F.array(*bad)))
    )
    is_bad = F.size(BAD_FIELDS) > 0
    return staged.select(
        *[_typed(F.col(f"text.{f.name}"), f.dataType).alias(f.name) for f in schema.fields],
        F.when(is_bad, F.col("raw")).alias("_raw"),
        BAD_FIELDS,
    )


def unparseable(value: Column, name: str) -> Column:
    return value.isNotNull() & TIMES[name](value).isNull()


def flag_times(typed: DataFrame, times: tuple[str, ...]) -> DataFrame:
    """For feeds that are typed already: ``_raw`` and ``_bad_fields`` as in ``flag_rejects``.

    A feed with an ``as_of_date`` is dated by that, not by ``dt``.
    """
    names = ["as_of_date" if n == "dt" and "as_of_date" in typed.columns else n for n in times]
    bad = [F.when(unparseable(F.col(n), n), F.lit(n)) for n in names if n in typed.columns]
    fields = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    row = F.struct(*(F.col(f"`{c}`") for c in typed.columns))
    flagged = typed.withColumn(BAD_FIELDS, fields)
    return flagged.withColumn("_raw", F.when(F.size(BAD_FIELDS) > 0, row))


def good_rows(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.size(BAD_FIELDS) == 0).drop("_raw", BAD_FIELDS)


def rejected_rows(flagged: DataFrame) -> DataFrame:
    """Rejected records as they came in, with the reason."""
    return flagged.where(F.size(BAD_FIELDS) > 0).select("_raw.*", BAD_FIELDS)


def split_rejects(
    raw: DataFrame, schema: T.StructType, corrupt_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    flagged = flag_rejects(raw, schema, corrupt_col)
    return good_rows(flagged), rejected_rows(flagged)


def read_flagged(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    layout: str = "lines",
    corrupt_col: str = CORRUPT,
    times: tuple[str, ...] = (),
) -> DataFrame:
    """A JSON feed with its rejects still in place: one pass for whoever stages both."""
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = _records(spark, path, text_schema.add(corrupt_col, T.StringType()), layout, corrupt_col)
    return flag_rejects(raw, schema, corrupt_col, times)


def _records(spark: SparkSession, path: str | list[str], schema: T.StructType, layout: str, corrupt_col: str | None) -> DataFrame:
    options = {"mode": "PERMISSIVE"} | ({"columnNameOfCorruptRecord": corrupt_col} if corrupt_col else {})
    if layout == "array":
        return array_elements(spark, path).select(F.from_json("value", schema, options).alias("record")).select("record.*")
    return spark.read.schema(schema).options(**options).json(path)


def read_feed(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    layout: str = "lines",
    corrupt_col: str | None = CORRUPT,
    times: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame | None]:
    """(good, rejected) of a feed; ``rejected`` is None where no split is made.

    ``lines``: one record per line; a line that is no record is rejected. ``array``: files holding one JSON
    array (or object) each; one with more values raises. Both are read by many tasks, whatever a file's size.
    ``parquet``: typed already; rejected are rows whose ``times`` do not parse.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, not {layout!r}")
    if layout == "parquet":
        # The files' own schema: the operators cast, so wider or narrower types are fine.
        typed = spark.read.parquet(*([path] if isinstance(path, str) else path))
        if corrupt_col is None or not times:
            return typed, None
        flagged = flag_times(typed, times)
        return good_rows(flagged), rejected_rows(flagged)
    if corrupt_col is None:
        return _records(spark, path, schema, layout, None), None
    flagged = read_flagged(spark, path, schema, layout=layout, corrupt_col=corrupt_col, times=times)
    return good_rows(flagged), rejected_rows(flagged)


def read_impressions(spark: SparkSession, path, **options):
    return read_feed(spark, path, impressions_schema, times=FEED_TIMES["impressions"], **options)


def read_clicks(spark: SparkSession, path, **options):
    return read_feed(spark, path, clicks_schema, times=FEED_TIMES["clicks"], **options)


def read_atc(spark: SparkSession, path, **options):
    return read_feed(spark, path, atc_schema, times=FEED_TIMES["atc"], **options)


def read_orders(spark: SparkSession, path, **options):
    return read_feed(spark, path, orders_schema, times=FEED_TIMES["orders"], **options)
