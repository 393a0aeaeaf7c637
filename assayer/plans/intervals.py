"""Windows, runs and events over positions: conversations' turns, users' events, documents' characters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.operators import intervals as I
from assayer.operators.ordered import quantiles
from assayer.plans.registry import Catalogue, table

catalogue = Catalogue()
add = catalogue.add


@add("W01_window_grid", "select doc_id, (row_number() over (partition by doc_id order by start) - 1)::int as window_idx, start from (select distinct doc_id, unnest(list_concat(generate_series(0::bigint, greatest(n_chars - 400, 0), 150), [greatest(n_chars - 400, 0)])) as start from documents where n_chars > 0)")
def w01(spark, sf):
    return I.grid(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 400, 150).select("doc_id", "window_idx", "start")


@add("W02_frame_rms", "select user_id, event_id, round(sqrt(s / 5), 6) as rms from (select user_id, event_id, sum(value * value) over w as s, count(value) over w as n from events window w as (partition by user_id order by event_id rows between current row and 4 following)) where n = 5")
def w02(spark, sf):
    return I.frame_rms(table(spark, sf, "events"), ["user_id"], "event_id", "value", 5).withColumn("rms", F.round("rms", 6))


@add("W03_active_regions", "select user_id, event_id from (select user_id, event_id, avg(case when value > 20 then 1.0 else 0.0 end) over w as share, count(*) over w as n, first_value(value) over w as a, last_value(value) over w as b from events window w as (partition by user_id order by event_id rows between current row and 4 following)) where n = 5 and share >= 0.8 and a > 20 and b > 20")
def w03(spark, sf):
    return I.active_regions(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 20, 5, 0.8).drop("value")


_PLACED = "(select user_id, event_id, value, row_number() over (partition by user_id order by event_id) - 1 as pos from events where user_id is not null and value is not null)"


def _placed(spark, sf):
    """Each user's events by their place: 0, 1, 2, ..."""
    rows = table(spark, sf, "events").where("user_id is not null and value is not null").select("user_id", "event_id", "value")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1)


@add("W04_disjoint_regions", f"""with c as (select user_id, pos from (select user_id, pos, avg(case when value > 20 then 1.0 else 0.0 end) over w as share, count(*) over w as n, first_value(value) over w as a, last_value(value) over w as b
  from {_PLACED} window w as (partition by user_id order by pos rows between current row and 4 following)) where n = 5 and share >= 0.6 and a > 20 and b > 20),
one as (select user_id, arg_min(pos, sha256('7:region-1:' || user_id || ':' || pos)) as start from c group by 1),
two as (select c.user_id, arg_min(c.pos, sha256('7:region-2:' || c.user_id || ':' || c.pos)) filter (where c.pos + 5 <= o.start or c.pos >= o.start + 5) as start, count(*) filter (where c.pos + 5 <= o.start or c.pos >= o.start + 5) as n_candidates from c join one o using (user_id) group by 1)
select user_id, one.start as first_start, two.start as second_start, two.start + 5 as second_end, n_candidates from one join two using (user_id)""")
def w04(spark, sf):
    """A region of each user's events by digest, and a second one that doesn't touch it."""
    found = I.active_regions(_placed(spark, sf), ["user_id"], "pos", "value", 20, 5, 0.6).select("user_id", "pos")
    one = I.chosen_regions(found, ["user_id"], "pos", 5, "region-1", 7).select("user_id", F.col("start").alias("first_start"), F.col("end").alias("first_end"))
    two = I.chosen_regions(found.join(one, "user_id"), ["user_id"], "pos", 5, "region-2", 7, ("first_start", "first_end"))
    out = one.join(two, "user_id")
    return out.select("user_id", "first_start", F.col("start").alias("second_start"), F.col("end").alias("second_end"), "n_candidates")


_EDIT = "(select doc_id, n_chars, n_chars // 4 as a, n_chars // 2 as b, 5 as f from documents where n_chars >= 100)"
_RUNS = f"""(select doc_id, n_chars, s as run_start, e as run_end, y as label from (select doc_id, n_chars, 0 as s, a as e, 0 as y from {_EDIT} union all select doc_id, n_chars, a, a + f, -1 from {_EDIT} union all select doc_id, n_chars, a + f, b - f, 1 from {_EDIT} union all select doc_id, n_chars, b - f, b, -1 from {_EDIT} union all select doc_id, n_chars, b, n_chars, 0 from {_EDIT}) where e > s)"""


def _runs(spark, sf):
    rows = table(spark, sf, "documents").where("n_chars >= 100").select("doc_id", "n_chars", F.expr("n_chars div 4").alias("a"), F.expr("n_chars div 2").alias("b"), F.lit(5).alias("f"))
    return I.labels_of_edit(rows, "n_chars", "a", "b", "f").select("doc_id", "n_chars", "run_start", "run_end", "label")


@add("W05_edit_labels", f"select doc_id, run_start, run_end, label from {_RUNS}")
def w05(spark, sf):
    return _runs(spark, sf).drop("n_chars")


_GUARDED = f"""(select doc_id, case when b is null then 7 else run_start + 8 end::bigint as run_start, case when a is null then n_chars - 7 else run_end - 7 end::bigint as run_end, label from (select *, lag(label) over w as b, lead(label) over w as a from {_RUNS} window w as (partition by doc_id order by run_start)) where label >= 0 and (case when a is null then n_chars - 7 else run_end - 7 end) > (case when b is null then 7 else run_start + 8 end))"""


@add("W06_dense_labels", f"select doc_id, label, count(*) as n, sum(position)::bigint as places from (select doc_id, label, unnest(range(run_start, run_end)) as position from {_RUNS}) group by 1, 2")
def w06(spark, sf):
    """One label for each position, summed up again."""
    dense = I.expanded(_runs(spark, sf), ["doc_id"])
    return dense.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum("position").alias("places"))


@add("W07_guarded_runs", f"select * from {_GUARDED}")
def w07(spark, sf):
    return I.guarded(_runs(spark, sf), ["doc_id"], "n_chars", 7).select("doc_id", "run_start", "run_end", "label")


@add("W21_guarded_core", f"""select e.doc_id, e.a + 13 as core_start, e.b - 12 as core_end, exists (select 1 from {_GUARDED} g where g.doc_id = e.doc_id and g.run_start <= e.a + 13 and e.b - 12 <= g.run_end and g.label = 1) as pure
from (select doc_id, n_chars // 4 as a, n_chars // 2 as b from documents where n_chars >= 200) e""")
def w21(spark, sf):
    """Cores of edits without crossfades and guard, and whether a guarded run of label 1 holds them."""
    edits = table(spark, sf, "documents").where("n_chars >= 200").selectExpr("doc_id", "n_chars div 4 as a", "n_chars div 2 as b", "5 as f", "1 as wanted")
    cored = I.guarded_core(edits, "a", "b", "f", 7)
    impure = I.impure_cores(cored, w07(spark, sf), ["doc_id"], "wanted").select("doc_id", F.lit(False).alias("_pure"))
    return cored.join(impure, "doc_id", "left").select("doc_id", "core_start", "core_end", F.coalesce("_pure", F.lit(True)).alias("pure"))


_WINDOWS = "(select doc_id, n_chars, (row_number() over (partition by doc_id order by start) - 1)::int as window_idx, start from (select distinct doc_id, n_chars, unnest(list_concat(generate_series(0::bigint, greatest(n_chars - 60, 0), 40), [greatest(n_chars - 60, 0)])) as start from documents where n_chars >= 100))"


def _windows(spark, sf):
    return I.grid(table(spark, sf, "documents").where("n_chars >= 100").select("doc_id", "n_chars"), "n_chars", 60, 40)


@add("W08_pure_windows", f"select w.doc_id, w.window_idx, coalesce(max(r.label), -1) as label from {_WINDOWS} w left join {_GUARDED} r on r.doc_id = w.doc_id and r.run_start <= w.start and w.start + 60 <= r.run_end group by 1, 2")
def w08(spark, sf):
    return I.pure_windows(_windows(spark, sf), w07(spark, sf), ["doc_id"], 60).select("doc_id", "window_idx", "label")


_CELLS = f"""(select doc_id, window_idx, start, coalesce(floor((lag(c) over w + c) / 2), 0)::bigint as cell_start, coalesce(floor((lead(c) over w + c) / 2), n_chars)::bigint as cell_end from (select *, least(start + 30.0, n_chars) as c from {_WINDOWS}) window w as (partition by doc_id order by start))"""


def _cells(spark, sf):
    return I.cells(_windows(spark, sf), ["doc_id"], "start", 60, "n_chars")


@add("W10_midpoint_cells", f"select doc_id, window_idx, cell_start, cell_end from {_CELLS}")
def w10(spark, sf):
    return _cells(spark, sf).select("doc_id", "window_idx", "cell_start", "cell_end")


@add("W11_smoothed", "select user_id, event_id, round((coalesce(lag(value) over w, value) + value + coalesce(lead(value) over w, value)) / 3, 6) as smooth from events window w as (partition by user_id order by event_id)")
def w11(spark, sf):
    return I.smoothed(table(spark, sf, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@add("W12_cell_counts", f"select doc_id, cell_start, cell_end, sum(case when label = 0 then least(cell_end, run_end) - greatest(cell_start, run_start) else 0 end)::bigint as n_zero, sum(case when label = 1 then least(cell_end, run_end) - greatest(cell_start, run_start) else 0 end)::bigint as n_one from {_CELLS} join {_RUNS} using (doc_id) where cell_start < run_end and run_start < cell_end group by 1, 2, 3")
def w12(spark, sf):
    return I.cell_counts(_cells(spark, sf), _runs(spark, sf).drop("n_chars"), ["doc_id"])


def _event_sql(threshold, column="p"):
    return f"""(select doc_id, min(cell_start) as start, max(cell_end) as "end", count(*) as n from (select *, sum(fresh) over (partition by doc_id order by cell_start, cell_end) as island from (select *, case when b is null or cell_start - b > 25 then 1 else 0 end as fresh from (select *, max(cell_end) over (partition by doc_id order by cell_start, cell_end rows between unbounded preceding and 1 preceding) as b from (select *, (window_idx * 7 + doc_id) % 10 / 10.0 as p from {_CELLS}) where {column} >= {threshold} and cell_end > cell_start))) group by doc_id, island)"""


def _events(spark, sf, threshold):
    scored = _cells(spark, sf).withColumn("p", (F.col("window_idx") * 7 + F.col("doc_id")) % 10 / 10.0)
    return I.events(scored, ["doc_id"], "p", threshold, 25)


@add("W09_merged_events", f"select * from {_event_sql(0.6)}")
def w09(spark, sf):
    return _events(spark, sf, 0.6)


@add("W14_matched_events", f"""with r as {_event_sql(0.6)}, f as {_event_sql(0.5)}, x as (select r.doc_id, r.start, r."end", f.start as f_start, f."end" as f_end, (least(r."end", f."end") - greatest(r.start, f.start))::double / (greatest(r."end", f."end") - least(r.start, f.start)) as iou from r join f using (doc_id) where f.start < r."end" and r.start < f."end"),
k as (select *, row_number() over (partition by doc_id, start, "end" order by iou desc, f_start) as k from x)
select r.doc_id, r.start, r."end", k.f_start, k.f_end, round(coalesce(k.iou, 0.0), 9) as iou, coalesce(k.iou, 0.0) >= 0.5 as hit_50, coalesce(k.iou, 0.0) >= 0.75 as hit_75 from r left join k on k.doc_id = r.doc_id and k.start = r.start and k."end" = r."end" and k.k = 1""")
def w14(spark, sf):
    return I.matched_events(_events(spark, sf, 0.5), _events(spark, sf, 0.6), ["doc_id"]).withColumn("iou", F.round("iou", 9))


@add("W16_distance_bands", "select d, count(*) as n from (select (case when x >= 0.05 then 1 else 0 end) + (case when x >= 0.15 then 1 else 0 end) + (case when x >= 0.25 then 1 else 0 end) + (case when x >= 0.5 then 1 else 0 end) + (case when x >= 1 then 1 else 0 end) as d from (select abs(value - 50) / 100 as x from events where value is not null)) group by 1")
def w16(spark, sf):
    return table(spark, sf, "events").where("value is not null").groupBy(I.distance_band(F.abs(F.col("value") - 50) / 100).alias("d")).agg(F.count("*").alias("n"))


@add("W17_role_runs", """with o as (select conv_id, turn, role, case when role is not distinct from lag(role) over w and lag(turn) over w is not null then 0 else 1 end as fresh from conversations window w as (partition by conv_id order by turn)),
i as (select *, sum(fresh) over (partition by conv_id order by turn) as run from o) select conv_id, role as state, min(turn) as first, max(turn) as last, count(*) as n from i group by conv_id, run, role""")
def w17(spark, sf):
    return I.runs(table(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role"))


@add("W18_quiet_ends", "select vec_id, (case when list_bool_or(q) then list_position(q, true) - 1 else 64 end) / 64.0::double as lead, (case when list_bool_or(q) then list_position(list_reverse(q), true) else 0 end) / 64.0::double as trail from (select vec_id, list_transform(embedding, lambda x: abs(x) > 0.15) as q from embeddings)")
def w18(spark, sf):
    """Trailing quiet counts from the last loud sample, that one included."""
    out = table(spark, sf, "embeddings").select("vec_id", I.quiet_ends(F.col("embedding"), 0.15, 64).alias("q"))
    return out.select("vec_id", F.col("q.lead").cast("double").alias("lead"), F.col("q.trail").cast("double").alias("trail"))


@add("W19_two_level_percentile", "select event_type, round(median(p), 6) as floor_level from (select event_type, user_id, quantile_cont(value, 0.1) as p from events group by 1, 2) group by 1")
def w19(spark, sf):
    each = quantiles(table(spark, sf, "events"), ["event_type", "user_id"], "value", {"p": 0.1})
    return quantiles(each, ["event_type"], "p", {"floor_level": 0.5}).select("event_type", F.round("floor_level", 6).alias("floor_level"))


@add("W20_threshold_sweep", "select t as threshold, label, round(avg(n), 6) as mean_over from (select t, label, len(list_filter(embedding, lambda x: abs(x) > t)) as n from embeddings, (select unnest([0.05::double, 0.1, 0.2]) as t)) group by 1, 2")
def w20(spark, sf):
    sweep = spark.createDataFrame([(t,) for t in (0.05, 0.1, 0.2)], "threshold double")
    rows = table(spark, sf, "embeddings").crossJoin(F.broadcast(sweep))
    return rows.groupBy("threshold", "label").agg(F.round(F.avg(F.size(F.filter("embedding", lambda x: F.abs(x) > F.col("threshold")))), 6).alias("mean_over"))


@add("W23_timeline_scale", "select event_id, round(40 + 920 * event_id / (select max(event_id) from events)::double, 6) as x from events")
def w23(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    return e.crossJoin(F.broadcast(e.agg(F.max("event_id").alias("top")))).select("event_id", F.round(40 + 920 * F.col("event_id") / F.col("top"), 6).alias("x"))


@add("W25_reference_masks", f"""with p as {_PLACED}, n as (select user_id, max(pos) + 1 as n from p group by 1), f as (select user_id, unnest(range(0, n // 2 + 1)) as frame from n),
l as (select f.user_id, f.frame, sqrt(sum(p.value::double * p.value) / 6) as rms from f join p on p.user_id = f.user_id and p.pos >= f.frame * 2 - 3 and p.pos < f.frame * 2 + 3 group by 1, 2),
m as (select user_id, frame, rms < max(rms) over (partition by user_id) * power(10, -0.5) as silent from l),
c as (select user_id, quantile_cont(rms, 0.2) as cut from l where rms > 1 group by 1), q as (select l.user_id, l.frame from l join c using (user_id) where rms > 1 and rms <= cut)
select user_id, count(*) filter (where m.silent) as n_silent, count(*) filter (where q.frame is not null) as n_quiet from p join m on m.user_id = p.user_id and m.frame = p.pos // 2 left join q on q.user_id = p.user_id and q.frame = p.pos // 2 group by p.user_id having count(*) filter (where m.silent) + count(*) filter (where q.frame is not null) > 0""".replace("select user_id, count(*) filter (where m.silent)", "select p.user_id, count(*) filter (where m.silent)"))
def w25(spark, sf):
    """Events under a user's silent frames (10 dB below the loudest) and under the quietest fifth of those above a floor."""
    rows = _placed(spark, sf)
    levels = I.frame_levels(rows, ["user_id"], "pos", "value", 6, 2)
    silent = I.masked(rows, I.silent_frames(levels, ["user_id"], 10), ["user_id"], "pos", 2).select("user_id", F.lit(1).alias("s"), F.lit(0).alias("q"))
    quiet = I.masked(rows, I.quiet_frames(levels, ["user_id"], 1, 0.2), ["user_id"], "pos", 2).select("user_id", F.lit(0).alias("s"), F.lit(1).alias("q"))
    return silent.union(quiet).groupBy("user_id").agg(F.sum("s").alias("n_silent"), F.sum("q").alias("n_quiet"))


QUERIES, ORACLE_SQL = catalogue.queries, catalogue.sql
