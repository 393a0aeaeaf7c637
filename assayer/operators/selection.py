"""Choosing rows and columns by name: tiers, refused members, labels, metrics, paths, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalar import finite, ratio


def tier(df: DataFrame, column: str, wanted) -> DataFrame:
    """The rows of one tier. A table without the column is an error: rows of several tiers aren't pooled unseen."""
    if column not in df.columns:
        raise ValueError(f"no column {column} to tell tiers apart")
    return df.where(F.col(column) == wanted)


def refused(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """offenders (in order) and n: the rows whose value is one of the members (a column of the same name) that must not be there."""
    found = df.join(members.select(column).distinct(), column, "left_semi")
    names = found.groupBy(column).agg(F.count("*").alias("n"))
    return names.agg(F.concat_ws(",", F.array_sort(F.collect_list(column))).alias("offenders"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows with these values; a list or tuple stands for any of its members."""
    for name, value in wanted.items():
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df


def label_index(df: DataFrame, column: str, names: list[str], out: str = "y") -> DataFrame:
    """Rows of the named classes only, with their 0-based number."""
    index = F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, k)))
    return df.where(F.col(column).isin(names)).withColumn(out, F.element_at(index, F.col(column)))


def metric(df: DataFrame, name: str) -> Column:
    """The column of a metric that is named as one column or as the difference ``a-b`` of two, which must exist."""
    parts = [name] if name in df.columns else name.split("-")
    if len(parts) > 2 or not set(parts) <= set(df.columns):
        raise ValueError(f"no metric {name}")
    return F.col(parts[0]) if len(parts) == 1 else F.col(parts[0]) - F.col(parts[1])


def kept_paths(df: DataFrame, path: str, folders: list[str], marks: list[str] = ()) -> DataFrame:
    """Rows whose path has none of these folders or file names as a part, and none of the marks anywhere."""
    out = df.where(~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders))))
    for mark in marks:
        out = out.where(~F.col(path).contains(mark))
    return out


def missing_keys(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that rows have and the wanted table lacks, each once."""
    return rows.select(*keys).distinct().join(wanted.select(*keys), keys, "left_anti")


def topology(df: DataFrame, **columns: str) -> DataFrame:
    """n, the number of distinct values of each column (by the given names), and whether all are unique."""
    out = df.agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(name) for name, c in columns.items()))
    unique = F.lit(True)
    for name in columns:
        unique = unique & (F.col(name) == F.col("n"))
    return out.withColumn("unique_keys", unique)


def array_faults(df: DataFrame, column: str, length: int, most: float) -> DataFrame:
    """Rows that break an array's contract, with the first rule that they break as reason: length, finite, peak."""
    peak = F.array_max(F.transform(column, lambda x: F.abs(x)))
    reason = F.when(F.size(column) != length, "length").when(F.exists(column, lambda x: ~finite(x)), "finite").when(peak > most, "peak")
    return df.withColumn("reason", reason).where("reason is not null")


def status(value: Column, bounds: list[tuple[float, str]], beyond: str, missing: str = "missing") -> Column:
    """The name of the first bound that a value lies below, ``beyond`` if none, ``missing`` for null."""
    out = F.when(value.isNull(), missing)
    for bound, name in bounds:
        out = out.when(value < bound, name)
    return out.otherwise(beyond)


def with_sidecar(df: DataFrame, sidecar: DataFrame, key: str, defaults: dict) -> DataFrame:
    """df with the sidecar's columns, or their defaults, and missing_sidecar."""
    own = sidecar.select(key, *defaults, F.lit(True).alias("_there"))
    out = df.join(own, key, "left").withColumn("missing_sidecar", F.col("_there").isNull()).drop("_there")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def share_over(df: DataFrame, by: list[str], value: str, cut: DataFrame) -> DataFrame:
    """flagged, n and share of each group's values above a cut (a table of one row and column)."""
    name = cut.columns[0]
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(cut))  # one row
    out = rows.groupBy(*by).agg(F.count_if(F.col(value) > F.col(name)).alias("flagged"), F.count("*").alias("n"))
    return out.withColumn("share", ratio(F.col("flagged"), F.col("n")))


def by_and_over_all(df: DataFrame, by: list[str], inner: str, *aggregates: Column) -> DataFrame:
    """Aggregates for each group and inner value, and for each group as a whole (inner is null), in one pass."""
    groups = [F.col(c) for c in by]
    return df.groupingSets([[*groups, F.col(inner)], groups], *by, inner).agg(*aggregates)


def counts_of_all(df: DataFrame, rows: str, columns: str, wanted: Column) -> DataFrame:
    """n of the wanted rows for all pairs of values that the table has anywhere, empty cells too."""
    grid = df.select(rows).distinct().crossJoin(df.select(columns).distinct())
    seen = df.where(wanted).groupBy(rows, columns).agg(F.count("*").alias("n"))
    return grid.join(seen, [rows, columns], "left").select(rows, columns, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def compared(df: DataFrame, chosen: DataFrame, key: str, **means: Column) -> DataFrame:
    """n and means of the rows that were chosen (admitted) and of the others."""
    mark = chosen.select(key).distinct().withColumn("_chosen", F.lit(True))
    rows = df.join(mark, key, "left").withColumn("admitted", F.coalesce("_chosen", F.lit(False)))
    return rows.groupBy("admitted").agg(F.count("*").alias("n"), *(F.avg(c).alias(n) for n, c in means.items()))


def probes(df: DataFrame, by: Column, name: str, **values: Column) -> DataFrame:
    """probe, group and mean: one pass over the table for all probes."""
    wide = df.groupBy(by.alias(name)).agg(*(F.avg(c).alias(n) for n, c in values.items()))
    return wide.unpivot(name, list(values), "probe", "m").select("probe", name, "m")


def recommended(value: Column, choices: list[tuple[float, str]], otherwise: str) -> Column:
    """The first choice whose bound the value exceeds."""
    out = None
    for bound, name in choices:
        out = F.when(value > bound, name) if out is None else out.when(value > bound, name)
    return out.otherwise(otherwise)
