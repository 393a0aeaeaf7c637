"""Windows and intervals over an integer axis; intervals are half-open runs, never one row per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalar import hash_order
from assayer.operators.ordered import quantiles


def grid(df: DataFrame, size: str, length: int, hop: int) -> DataFrame:
    """Adds start and window_idx: 0, hop, 2 hop, ... and a last window that ends at the size. Empty for size 0."""
    last = F.greatest(F.col(size) - length, F.lit(0)).cast("long")
    starts = F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(hop).cast("long")), F.array(last))
    return df.where(F.col(size) > 0).select("*", F.posexplode(starts).alias("window_idx", "start"))


def frame_rms(df: DataFrame, by: list[str], order: str, value: str, length: int) -> DataFrame:
    """Root mean square of each complete run of ``length`` rows, at its first."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = w.rowsBetween(0, length - 1)
    out = df.select(*by, order, F.sum(F.col(value) * F.col(value)).over(ahead).alias("s"), F.count(value).over(ahead).alias("n"))
    return out.where(F.col("n") == length).select(*by, order, F.sqrt(F.greatest("s", F.lit(0.0)) / length).alias("rms"))


def active_regions(df: DataFrame, by: list[str], order: str, value: str, threshold: float, length: int, share: float) -> DataFrame:
    """Rows at which ``length`` rows begin of which so large a share lies above the threshold, the first and the last too."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, length - 1)
    over = F.col(value) > threshold
    first, last = F.first(value).over(w), F.last(value).over(w)
    out = df.withColumns({"_share": F.avg(F.when(over, 1.0).otherwise(0.0)).over(w), "_n": F.count("*").over(w), "_a": first, "_b": last})
    fit = (F.col("_n") == length) & (F.col("_share") >= share) & (F.col("_a") > threshold) & (F.col("_b") > threshold)
    return out.where(fit).drop("_share", "_n", "_a", "_b")


def smoothed(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds smooth, the mean of three with the edge repeated."""
    w = Window.partitionBy(*by).orderBy(order)
    v = F.col(value)
    return df.withColumn("smooth", (F.coalesce(F.lag(value).over(w), v) + v + F.coalesce(F.lead(value).over(w), v)) / 3)


def cells(df: DataFrame, by: list[str], start: str, length: int, size: str) -> DataFrame:
    """Adds cell_start, cell_end: each window's part of [0, size), cut half way between neighbouring centres."""
    w = Window.partitionBy(*by).orderBy(start)
    centre = F.least(F.col(start) + length / 2, F.col(size))
    out = df.withColumn("_c", centre)
    edge = F.floor((F.lag("_c").over(w) + F.col("_c")) / 2)
    after = F.floor((F.lead("_c").over(w) + F.col("_c")) / 2)
    return out.withColumns({"cell_start": F.coalesce(edge, F.lit(0)).cast("long"), "cell_end": F.coalesce(after, F.col(size)).cast("long")}).drop("_c")


def islands(df: DataFrame, by: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Intervals merged where the gap is at most ``gap`` (0: touching ones): start, end, n."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.where(F.col(end) > F.col(start)).withColumn("_new", F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_island")


def events(scored: DataFrame, by: list[str], probability: str, threshold: float, merge: int = 0) -> DataFrame:
    """Cells whose probability reaches the threshold, merged into events."""
    return islands(scored.where(F.col(probability) >= threshold), by, "cell_start", "cell_end", merge)


def runs(df: DataFrame, by: list[str], order: str, state: Column) -> DataFrame:
    """Maximal runs of one state in the given order: state, first, last, n."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.select(*by, F.col(order).alias("_o"), state.alias("state"))
    w = Window.partitionBy(*by).orderBy("_o")
    rows = rows.withColumn("_new", F.when(F.lag("state").over(w).eqNullSafe(F.col("state")) & F.lag("_o").over(w).isNotNull(), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_run", "state").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count("*").alias("n")).drop("_run")


def labels_of_edit(df: DataFrame, size: str, start: str, end: str, fade: str) -> DataFrame:
    """Label runs of a text with one edit: 0 outside, 1 in the core, -1 over the crossfades; empty runs dropped,
    equal neighbours merged. Adds start, end, label."""
    n, a, b, f = (F.col(c).cast("long") for c in (size, start, end, fade))
    run = lambda s, e, y: F.struct(s.alias("run_start"), e.alias("run_end"), F.lit(y).alias("label"))
    parts = F.array(run(F.lit(0).cast("long"), a, 0), run(a, a + f, -1), run(a + f, b - f, 1), run(b - f, b, -1), run(b, n, 0))
    return df.select("*", F.inline(F.filter(parts, lambda r: r["run_end"] > r["run_start"])))


def guarded(runs_: DataFrame, by: list[str], size: str, guard: int) -> DataFrame:
    """The parts of each labelled run that keep their label when labels within ``guard`` of a change, of an ignored
    run or of an end are ignored too. An ignored band [s, e) grows to [s - guard, e + guard + 1): the first sample behind it is
    itself a change."""
    if guard == 0:
        return runs_.where("label >= 0").select(*by, "run_start", "run_end", "label")
    w = Window.partitionBy(*by).orderBy("run_start")
    before, after = F.lag("label").over(w), F.lead("label").over(w)
    start = F.when(before.isNull(), F.lit(guard)).otherwise(F.col("run_start") + guard + 1)
    end = F.when(after.isNull(), F.col(size) - guard).otherwise(F.col("run_end") - guard)
    out = runs_.select(*by, start.cast("long").alias("run_start"), end.cast("long").alias("run_end"), "label")
    return out.where("label >= 0 and run_end > run_start")


#: Positions in a stretch of an axis. Intervals meet in the stretches that they reach into, so what is tried
#: grows with how many lie side by side, not with how many a key has.
STRETCH = 1 << 12


def _stretches(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row for each stretch that [start, end) reaches into, as ``stretch``; empty intervals give none."""
    last = F.floor((end - 1) / STRETCH).cast("long")
    return df.where(end > start).withColumn("stretch", F.explode(F.sequence(F.floor(start / STRETCH).cast("long"), last)))


def pure_windows(windows: DataFrame, runs_: DataFrame, by: list[str], length: int) -> DataFrame:
    """Adds label: that of the run which holds the whole window, else -1."""
    run = _stretches(runs_.select(*by, "run_start", "run_end", "label"), F.col("run_start"), F.col("run_end"))
    own = windows.withColumn("stretch", F.floor(F.col("start") / STRETCH).cast("long"))
    held = own.join(run, [*by, "stretch"]).where((F.col("run_start") <= F.col("start")) & (F.col("start") + length <= F.col("run_end")))
    held = held.groupBy(*by, "window_idx").agg(F.max("label").alias("label"))
    return windows.join(held, [*by, "window_idx"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def overlaps(left: DataFrame, right: DataFrame, by: list[str], first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Pairs of intervals of one key that overlap, each once. first and second name the columns of both sides' ends."""
    (a, b), (c, d) = first, second
    pairs = _stretches(left, F.col(a), F.col(b)).join(_stretches(right, F.col(c), F.col(d)), [*by, "stretch"])
    met = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    # A pair that meets in several stretches counts in that where its overlap begins.
    return pairs.where(met & (F.floor(F.greatest(a, c) / STRETCH) == F.col("stretch"))).drop("stretch")


def cell_counts(cells_: DataFrame, runs_: DataFrame, by: list[str]) -> DataFrame:
    """Samples of class 0 and of class 1 in each cell."""
    both = overlaps(cells_, runs_, by, ("cell_start", "cell_end"), ("run_start", "run_end"))
    width = F.least("cell_end", "run_end") - F.greatest("cell_start", "run_start")
    of = lambda label: F.sum(F.when(F.col("label") == label, width).otherwise(0))
    return both.groupBy(*by, "cell_start", "cell_end").agg(of(0).alias("n_zero"), of(1).alias("n_one"))


def matched_events(found: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """For each reference event its best found one by intersection over union, the earliest of equals; at 0.5 and 0.75."""
    f = found.select(*by, F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    r = reference.select(*by, "start", "end")
    both = overlaps(r, f, by, ("start", "end"), ("f_start", "f_end"))
    shared = F.least("end", "f_end") - F.greatest("start", "f_start")
    iou = shared / (F.greatest("end", "f_end") - F.least("start", "f_start"))
    top = both.groupBy(*by, "start", "end").agg(F.min(F.struct((-iou).alias("less"), "f_start", "f_end")).alias("top"))
    out = r.join(top, [*by, "start", "end"], "left").withColumn("iou", F.coalesce(-F.col("top.less"), F.lit(0.0)))
    best = F.col("top.f_start").alias("f_start"), F.col("top.f_end").alias("f_end")
    return out.select(*by, "start", "end", *best, "iou", (F.col("iou") >= 0.5).alias("hit_50"), (F.col("iou") >= 0.75).alias("hit_75"))


def expanded(runs_: DataFrame, by: list[str]) -> DataFrame:
    """One row for each position of labelled runs: by, position, label. Runs are to be preferred wherever they will do."""
    rows = runs_.where("run_end > run_start")
    return rows.select(*by, F.explode(F.sequence("run_start", F.col("run_end") - 1)).alias("position"), "label")


def guarded_core(df: DataFrame, start: str, end: str, fade: str, guard: int) -> DataFrame:
    """Adds core_start, core_end: an edit without its crossfades and a guard; the first position behind a guarded change is
    itself one, hence one more at the start. An empty core is an error."""
    a, b = F.col(start) + F.col(fade) + guard + 1, F.col(end) - F.col(fade) - guard
    out = df.withColumns({"core_start": a.cast("long"), "core_end": b.cast("long")})
    said = F.concat(F.lit("an edit without a core: "), F.concat_ws("-", F.col(start).cast("string"), F.col(end).cast("string")))
    return out.withColumn("core_end", F.when(F.col("core_start") < F.col("core_end"), F.col("core_end")).otherwise(F.raise_error(said).cast("long")))


def impure_cores(cored: DataFrame, kept: DataFrame, by: list[str], wanted: str) -> DataFrame:
    """The rows of guarded_core() whose core isn't held by one guarded run (see guarded()) of the label in ``wanted``."""
    run = kept.withColumnsRenamed({c: f"_{c}" for c in ("run_start", "run_end", "label")})
    holds = (F.col("_run_start") <= F.col("core_start")) & (F.col("core_end") <= F.col("_run_end")) & (F.col("_label") == F.col(wanted))
    held = cored.select(*by, "core_start", "core_end", wanted).join(run, by).where(holds).select(*by, "core_start", "core_end").distinct()
    return cored.join(held, [*by, "core_start", "core_end"], "left_anti")


def chosen_regions(candidates: DataFrame, by: list[str], start: str, length: int, namespace: str, seed: int, taken: tuple[str, str] | None = None) -> DataFrame:
    """One candidate of each key, by digest of (key, start): by, start, end, n_candidates. taken: columns of an interval that the
    choice must not touch (null: none). A key without a candidate left has a row with a null start."""
    free = F.lit(True)
    if taken:
        free = F.coalesce((F.col(start) + length <= F.col(taken[0])) | (F.col(start) >= F.col(taken[1])), F.lit(True))
    digest = hash_order(namespace, seed, F.concat_ws(":", *(F.col(c).cast("string") for c in by), F.col(start).cast("string")))
    first = F.min(F.when(free, F.struct(digest.alias("digest"), F.col(start).alias("start")))).alias("first")
    out = candidates.groupBy(*by).agg(first, F.count_if(free).alias("n_candidates"))
    return out.select(*by, F.col("first.start").alias("start"), (F.col("first.start") + length).alias("end"), "n_candidates")


def frame_levels(df: DataFrame, by: list[str], order: str, value: str, length: int, hop: int) -> DataFrame:
    """Root mean square of frames centred on every ``hop``-th row, with zeros beyond the ends: by, frame, rms. order: 0, 1, 2, ...

    A row reaches into at most ceil(length / hop) + 1 frames, so frames are sums by key and frame, not windows over a key."""
    half = length // 2
    at = F.col(order).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.floor((at - length + half) / hop).cast("long") + 1)
    last = F.floor((at + half) / hop).cast("long")
    size = df.groupBy(*by).agg(F.floor((F.max(at) + 1) / hop).alias("_last"))
    rows = df.select(*by, F.explode(F.sequence(first, last)).alias("frame"), (F.col(value).cast("double") * F.col(value)).alias("_v"))
    out = rows.groupBy(*by, "frame").agg(F.sqrt(F.sum("_v") / length).alias("rms")).join(size, by)
    return out.where(F.col("frame") <= F.col("_last")).drop("_last")


def silent_frames(levels: DataFrame, by: list[str], below: float) -> DataFrame:
    """Frames more than ``below`` decibels under their key's loudest one."""
    loudest = levels.groupBy(*by).agg(F.max("rms").alias("_top"))
    floor = F.col("_top") * 10 ** (-below / 20)
    return levels.join(loudest, by).where(F.col("rms") < floor).drop("_top")


def quiet_frames(levels: DataFrame, by: list[str], least: float, share: float) -> DataFrame:
    """Of the frames louder than ``least``, those up to the share's quantile of their levels in their key."""
    recorded = levels.where(F.col("rms") > least)
    cut = quantiles(recorded, by, "rms", {"_cut": share}).drop("n")
    return recorded.join(cut, by).where(F.col("rms") <= F.col("_cut")).drop("_cut")


def masked(df: DataFrame, frames: DataFrame, by: list[str], order: str, hop: int) -> DataFrame:
    """The rows that the reference's frames cover by place: a frame stands for ``hop`` rows from its own place on."""
    return df.withColumn("frame", F.floor(F.col(order) / hop).cast("long")).join(frames.select(*by, "frame"), [*by, "frame"], "left_semi").drop("frame")


def distance_band(distance: Column, edges: tuple[float, ...] = (0.05, 0.15, 0.25, 0.5, 1.0)) -> Column:
    """Number of the half-open band that a distance falls into."""
    out = F.lit(0)
    for e in edges:
        out = out + (distance >= e).cast("int")
    return out


def quiet_ends(x: Column, threshold: float, rate: int) -> Column:
    """(lead, trail) seconds of quiet at an array's ends; an all-quiet one is (n / rate, 0)."""
    index = F.filter(F.transform(x, lambda v, i: F.when(F.abs(v) > threshold, i)), lambda i: i.isNotNull())
    n = F.size(x)
    loud = F.size(index) > 0
    lead = F.when(loud, F.element_at(index, 1)).otherwise(n) / rate
    trail = F.when(loud, n - F.element_at(index, -1)).otherwise(0) / rate
    return F.struct(lead.alias("lead"), trail.alias("trail"))


def activity(level: Column, threshold: float) -> Column:
    """0 below the threshold, 1 below ten times it, else 2; a boundary belongs to the upper bin."""
    return F.when(level < threshold, 0).when(level < 10 * threshold, 1).otherwise(2)


def score_guard(windows: list[tuple[int, int, int]], base: int) -> int:
    """Samples by which a score at one place can depend on others: (window, hop, smoothing) of each candidate."""
    return base + max(-(-w // 2) for w, _, _ in windows) + max(h * (s // 2) for _, h, s in windows) + max(-(-h // 2) for _, h, _ in windows)
