"""Tables that must be what they claim: guards, re-keyed predictions, ragged windows, paired recordings, log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.files import BadSource
from assayer.sources.sinks import publish, seal


def require_columns(df: DataFrame, columns: list[str], why: str) -> DataFrame:
    """df, if it has these columns: rows of several kinds aren't pooled without the column that tells them apart."""
    if missing := [c for c in columns if c not in df.columns]:
        raise BadSource(f"{why} needs the columns {missing}")
    return df


def require_primary(df: DataFrame, why: str, derived: str = "derived", tier: str = "tier") -> DataFrame:
    """df, if no row is derived; a null flag is a derived row, as nothing vouches for it."""
    require_columns(df, [derived], why)
    bad = df.where(F.coalesce(F.col(derived), F.lit(True)))
    tiers = F.array_join(F.array_sort(F.collect_set(tier)), ", ") if tier in df.columns else F.lit("")
    found = bad.agg(F.count("*").alias("n"), tiers.alias("tiers")).first()
    if found.n:
        raise BadSource(f"{why} needs primary rows, but {found.n} are derived ({found.tiers})")
    return df


def _require_none(df: DataFrame, columns: list[str], why: str) -> None:
    if found := df.select(*columns).limit(3).collect():
        raise BadSource(f"{why}: {[tuple(r) for r in found]}")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """An error where either side has a key that the other lacks, or has one twice."""
    for df, name in ((left, "left"), (right, "right")):
        _require_none(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), keys, f"repeated keys on the {name}")
    a, b = left.select(*keys), right.select(*keys)
    _require_none(a.join(b, keys, "left_anti"), keys, "keys without a prediction")
    _require_none(b.join(a, keys, "left_anti"), keys, "predictions without a row")


def with_predictions(rows: DataFrame, saved: DataFrame, keys: list[str], checked: list[str] = ()) -> DataFrame:
    """rows with the columns of saved predictions. Both have the same keys, and equal values in the ``checked`` columns."""
    same_keys(rows, saved, keys)
    renamed = saved.withColumnsRenamed({c: f"_saved_{c}" for c in checked})
    out = rows.join(renamed, keys)
    differ = [~F.col(c).eqNullSafe(F.col(f"_saved_{c}")) for c in checked]
    for c, bad in zip(checked, differ):
        _require_none(out.where(bad), keys, f"{c} differs from what was predicted on")
    return out.drop(*(f"_saved_{c}" for c in checked))


def write_windows(windows: DataFrame, path: str, keys: list[str], split: str = "split") -> None:
    """One row for each window, in folders by split, with a digest of each row; published whole or not at all."""
    sealed = windows.join(seal(windows, keys), keys)
    same_keys(windows, sealed, keys)

    def check(back: DataFrame) -> None:
        same_keys(windows, back, keys)

    publish(sealed.repartition(split).sortWithinPartitions(*keys), path, check)


def read_windows(spark: SparkSession, path: str, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    """The windows of write_windows(). A row that doesn't fit its digest, or keys other than the expected ones, are an error."""
    df = spark.read.parquet(path)
    rows = df.drop("sha256")
    now = seal(rows, keys).withColumnRenamed("sha256", "_now")
    _require_none(df.select(*keys, "sha256").join(now, keys, "left").where("not sha256 <=> _now"), keys, "rows that were changed")
    if expected is not None:
        same_keys(expected, rows, keys)
    return rows


def write_quality(per_row: DataFrame, path: str, by: list[str], values: list[str]) -> None:
    """Two tables in one folder: the rows, and each group's mean, deviation and count of the values, read back from them."""
    publish(per_row, f"{path}/rows")
    rows = per_row.sparkSession.read.parquet(f"{path}/rows")
    each = (f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count)))
    publish(rows.groupBy(*by).agg(*each), f"{path}/groups")


def paired_problems(members: DataFrame, group: str, condition: str, reference: str, rate: int, root: str) -> DataFrame:
    """Each group with its first problem, null if none: group, problem. members: path, duration (recorded, seconds),
    samples (array), and the columns named.

    A recorded duration is within half a sample of the real one, all members are of one length, no member's samples equal
    the reference's, and no path leads out of the root.
    """
    n = F.size("samples")
    outside = F.col("path").contains("/../") | ~F.col("path").startswith(root.rstrip("/") + "/")
    bad_record = F.col("duration").isNull() | F.isnan("duration") | (F.col("duration") <= 0) | (F.abs("duration") == float("inf"))
    away = F.abs(n / rate - F.col("duration")) > 0.5 / rate
    content = F.sha2(F.to_json("samples"), 256)
    ref = F.max(F.when(F.col(condition) == reference, content))
    others = F.collect_set(F.when(F.col(condition) != reference, content))  # a handful of conditions
    out = members.groupBy(group).agg(
        F.max(outside).alias("outside"), F.max(bad_record).alias("bad_record"), F.max(away).alias("away"), F.min(n).alias("least"), F.max(n).alias("most"),
        ref.alias("ref"), others.alias("others"),
    )
    problem = (
        F.when(F.col("outside"), "path outside the root").when(F.col("ref").isNull(), "no reference").when(F.col("bad_record"), "no usable duration")
        .when(F.col("away"), "duration unlike the recording").when(F.col("least") != F.col("most"), "members of different lengths")
        .when(F.array_contains("others", F.col("ref")), "a member identical to the reference")
    )
    return out.select(group, problem.alias("problem"))


#: Characters that a line of nothing but a progress bar is made of. Fixed value.
_BAR = r"^[\s|/\d▏▎▍▌▋▊▉█-]+$"


def without_progress(text: Column) -> Column:
    """Log text without progress bars: of a line that was redrawn the last state, and no line that is only a bar or has one."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.rtrim(F.element_at(F.split(line, "\r"), -1)))
    kept = F.filter(lines, lambda line: (line != "") & ~line.rlike(r"\d+%\|") & ~line.rlike(_BAR))
    return F.array_join(kept, "\n")
