"""Arrays, structs and reshaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unwind(df: DataFrame, array: str, name: str, keep_empty: bool = False, index: str | None = None) -> DataFrame:
    """One row per element. keep_empty keeps rows whose array is null or empty, with a null element.
    index names a column for the element's place, from 0."""
    if index:
        return df.select("*", (F.posexplode_outer if keep_empty else F.posexplode)(array).alias(index, name))
    return df.select("*", (F.explode_outer if keep_empty else F.explode)(array).alias(name))


def replace_root(df: DataFrame, struct: str) -> DataFrame:
    """The fields of a struct column as the columns of the table."""
    return df.select(f"{struct}.*")


def without(df: DataFrame, *names: str) -> DataFrame:
    """All columns but some; a dotted name drops a field of a struct."""
    for n in names:
        top, _, rest = n.partition(".")
        df = df.withColumn(top, F.col(top).dropFields(rest)) if rest else df.drop(top)
    return df


def facets(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(facet, key, n) for several dimensions in one pass over the table. Array dimensions count each
    element; null keys are left out."""


    def tagged(name: str, c: Column) -> Column:
        is_array = dict(df.select(c.alias("x")).dtypes)["x"].startswith("array")
        one = c.cast("array<string>") if is_array else F.array(c.cast("string"))
        return F.transform(F.coalesce(one, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("facet"), v.alias("key")))

    arrays = [tagged(name, c) for name, c in dims.items()]
    return df.select(F.explode(F.concat(*arrays)).alias("f")).where("f.key is not null").groupBy("f.facet", "f.key").agg(F.count(F.lit(1)).alias("n"))


def pivot_sums(df: DataFrame, keys: list[str], by: str, values: list[str], measure: Column) -> DataFrame:
    """One column per given value of `by` with the summed measure, 0 where there is none."""
    aggs = [F.coalesce(F.sum(F.when(F.col(by) == v, measure)), F.lit(0)).alias(v) for v in values]
    return df.groupBy(*keys).agg(*aggs)


def group_map(df: DataFrame, key: str, value: Column) -> DataFrame:
    """All groups as one map column `groups`; for keys of a known small number."""
    return df.groupBy(key).agg(value.alias("v")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(key), F.lit("unknown")), "v")))).alias("groups"))


def union_tagged(parts: dict[str, DataFrame], tag: str = "type") -> DataFrame:
    """Rows of different kinds under each other; columns that a kind lacks are null."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def each_of(df: DataFrame, columns: list[str], build: Callable[[str], Column]) -> DataFrame:
    """Unpivot: one row for each of the columns, as the struct that build makes of its name."""
    return df.select("*", F.explode(F.array(*[build(c) for c in columns])).alias("item"))
