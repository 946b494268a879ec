"""Row digests and order-free table digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.segments import day_totals

SLICE_STARTS = (1, 16, 31, 46)
SLICE_LENGTH = 15


def framed(columns: Sequence[Column]) -> Column:
    """Length-prefixed text of all columns; NULL and any delimiter inside a value stay distinct."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n")))
    return F.concat(*parts)


def nested_text(column: Column, kind: T.DataType) -> Column:
    """Text of a value in which no two different values look alike, whatever they are made of.

    Arrays, structs and maps are framed part by part with lengths, maps in the order of their keys;
    binary values are written in hex; plain values as ``cast`` writes them.
    """
    if isinstance(kind, T.ArrayType):
        parts = F.transform(column, lambda x: framed_text(nested_text(x, kind.elementType)))
        return F.concat(F.lit("["), F.size(column).cast("string"), F.lit("]"), F.array_join(parts, ""))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.concat(F.lit("{"), *[framed_text(nested_text(column[f.name], f.dataType)) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(column), lambda e: F.concat(
            framed_text(nested_text(e["key"], kind.keyType)), framed_text(nested_text(e["value"], kind.valueType))))
        return F.concat(F.lit("<"), F.size(column).cast("string"), F.lit(">"), F.array_join(F.sort_array(pairs), ""))
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    return column.cast("string")


def framed_text(text: Column) -> Column:
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def row_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(framed(columns), 256)


def schema_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """Digest of a row's columns, nested ones framed all the way down; for plain columns the same as ``row_digest``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.sha2(F.concat(*[framed_text(nested_text(F.col(c), kinds[c])) for c in columns]), 256)


def digest_slices(digest: Column) -> list[Column]:
    """Four 60-bit integers that make up a hex digest (the last four hex digits are not used)."""
    return [F.conv(F.substring(digest, start, SLICE_LENGTH), 16, 10).cast("bigint") for start in SLICE_STARTS]


def _header(df: DataFrame, columns: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ",".join(f"{name}:{types[name]}" for name in columns)


def _sealed(sums: DataFrame, by: Sequence[str], header: str) -> DataFrame:
    parts = [F.lit(header), F.col("row_count").cast("string"), *[F.col(f"__s{i}").cast("decimal(38,0)").cast("string") for i in range(4)]]
    return sums.select(*by, "row_count", F.sha2(F.concat_ws("|", *parts), 256).alias("content_sha256"))


def table_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Row count and one digest per group, independent of row order.

    The digest adds up slices of the row digests, so it is built by partial
    aggregation and duplicates count; names and types of the columns are part
    of it.
    """
    digest = schema_digest(df, columns)
    rows = df.select(*by, digest.alias("__digest"))
    slices = [s.cast("decimal(20,0)").alias(f"__s{i}") for i, s in enumerate(digest_slices(F.col("__digest")))]
    sums = (
        rows.select(*by, *slices).groupBy(*by)
        .agg(F.count("*").alias("row_count"),
             *[F.coalesce(F.sum(f"__s{i}").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(f"__s{i}")
               for i in range(4)])
    )
    return _sealed(sums, by, _header(df, columns))


def segment_digest(segments: DataFrame, columns: Sequence[str], first_day: Column | None = None, last_day: Column | None = None,
                   counts: Mapping[str, Column] | None = None) -> DataFrame:
    """``table_digest`` by day of the daily table that segments stand for; the day itself is not among the columns.

    Each segment's digest is made once and enters and leaves the running sum.  ``counts`` are whole numbers to add up
    by day in the same pass.  Slices are added up as halves of 30 bits: plain numbers, exact for 2**33 segments.
    """
    rows = segments.withColumn("__digest", schema_digest(segments, columns))
    values = {"row_count": F.lit(1), **(counts or {})}
    for i, s in enumerate(digest_slices(F.col("__digest"))):
        values |= {f"__h{i}": F.shiftright(s, 30), f"__l{i}": s.bitwiseAND(F.lit((1 << 30) - 1).cast("bigint"))}
    sums = day_totals(rows, [], values, first_day, last_day, whole=list(values))
    whole = {f"__s{i}": F.col(f"__h{i}").cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + F.col(f"__l{i}").cast("decimal(20,0)") for i in range(4)}
    return _sealed(sums.withColumns(whole), ["day", *(counts or {})], _header(segments, columns))
