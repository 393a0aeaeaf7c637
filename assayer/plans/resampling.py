"""Bootstrap intervals. Draws are digests, so SQL draws the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import resample
from assayer.plans import grouped as G
from assayer.plans import ranking as R
from assayer.plans.registry import Catalogue, table

catalogue = Catalogue()
add = catalogue.add

_PICK = "('0x' || left(sha256('{seed}:' || draw || ':' || k), 12))::bigint % m"


def _drawn(units: str, unit: str, n: int, seed: int) -> str:
    """SQL of draws(): units is a query that gives distinct ``unit`` values."""
    placed = f"select {unit}, row_number() over (order by sha256('{seed}:draw:' || {unit}), {unit}) - 1 as place, count(*) over () as m from ({units})"
    pick = _PICK.format(seed=seed)
    return f"""placed as ({placed}), picks as (select draw, place, count(*) as w from (select draw, {pick} as place from (select m, place as k, unnest(range(0, {n})) as draw from placed)) group by 1, 2),
drawn as (select draw, {unit}, w from picks join placed using (place))"""


_LENGTHS = R._LENGTHS.format("quality")


@add("B01_eer_interval", _LENGTHS + f""", s as (select condition, is_ref, score::double as score, row_number() over (partition by condition, is_ref order by score) - 1 as place, count(*) over (partition by condition, is_ref) as m from x),
pick as (select condition, is_ref, draw, place, count(*) as w from (select condition, is_ref, draw, {_PICK.format(seed=17)} as place from (select condition, is_ref, m, place as k, unnest(range(0, 60)) as draw from s)) group by 1, 2, 3, 4),
t as (select condition, draw, score, coalesce(sum(w) filter (where is_ref), 0) as p, coalesce(sum(w) filter (where not is_ref), 0) as q from pick join s using (condition, is_ref, place) group by 1, 2, 3),
c as (select *, sum(p) over w as pc, sum(q) over w as qc, sum(p) over (partition by condition, draw) as pa, sum(q) over (partition by condition, draw) as qa from t window w as (partition by condition, draw order by score)),
d as (select *, pc::double / pa as frr, (qa - qc)::double / qa as far, pc * qa = (qa - qc) * pa as exact, pc * qa >= (qa - qc) * pa as crossed from c where pa > 0 and qa > 0),
e as (select *, coalesce(lag(frr) over w, 0.0) as frr0, coalesce(lag(far) over w, 1.0) as far0 from d window w as (partition by condition, draw order by score)),
f as (select *, row_number() over (partition by condition, draw order by score) as k from e where crossed),
g as (select condition, case when exact then frr else frr0 + (far0 - frr0) / ((far0 - frr0) - (far - frr)) * (frr - frr0) end as eer from f where k = 1)
select condition, round(quantile_cont(eer, 0.025), 9) as low, round(quantile_cont(eer, 0.975), 9) as high from g group by 1""")
def b01(spark, sf):
    """Intervals of the error rate at which texts of two qualities are told apart by length, by language."""
    out = resample.eer_interval(R._lengths(spark, sf), ["condition"], "score", "is_ref", 60, 17)
    return out.select("condition", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_USERS = "select distinct user_id from events where user_id is not null"


@add("B02_grouped_interval", f"""with {_drawn(_USERS, 'user_id', 200, 404)}, s as (select user_id, count(*) filter (where event_type = 'purchase') as a, count(*) as b from events group by 1),
v as (select draw, sum(w * a) / sum(w * b)::double as v from drawn join s using (user_id) group by 1) select round(quantile_cont(v, 0.025), 9) as low, round(quantile_cont(v, 0.975), 9) as high from v""")
def b02(spark, sf):
    e = table(spark, sf, "events").where("user_id is not null")
    bought = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    out = resample.ratio_interval(e, "user_id", bought, F.lit(1), resample.draws(e, "user_id", 200, 404))
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@add("B02_macro_f1_interval", f"""with {_drawn("select distinct lang from documents join labels using (doc_id) where lang is not null", "lang", 100, 405)}, cells as (select lang, truth, predicted, count(*) as c from {G._PRED} group by 1, 2, 3),
n as (select draw, truth, predicted, sum(w * c) as n from drawn join cells using (lang) group by 1, 2, 3), l as (select unnest([0, 1]) as label), dr as (select distinct draw from drawn),
s as (select dr.draw, l.label, coalesce(sum(n) filter (where truth = l.label), 0) as sup, coalesce(sum(n) filter (where predicted = l.label), 0) as called, coalesce(sum(n) filter (where truth = l.label and predicted = l.label), 0) as hit from dr cross join l left join n on n.draw = dr.draw group by 1, 2),
m as (select draw, avg(coalesce(2 * hit / nullif(sup + called, 0)::double, 0)) as m from s group by 1) select round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high from m""")
def b02_macro(spark, sf):
    rows = G._predicted(spark, sf).where("lang is not null")
    labels = spark.createDataFrame([(0,), (1,)], "label int")
    out = resample.macro_f1_interval(rows, "lang", "truth", "predicted", labels, resample.draws(rows, "lang", 100, 405))
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@add("B03_paired_change", f"""with {_drawn(_USERS, 'user_id', 200, 405)}, a as (select user_id, avg(value) as a from events where event_type = 'view' group by 1), b as (select user_id, avg(value) as b from events where event_type = 'click' group by 1),
v as (select draw, sum(w * (b - a)) / sum(w) as v from drawn join a using (user_id) join b using (user_id) where a is not null and b is not null group by 1) select round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, count(v) as n_draws from v""")
def b03(spark, sf):
    e = table(spark, sf, "events").where("user_id is not null")
    out = resample.paired_change(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", F.col("value"), resample.draws(e, "user_id", 200, 405))
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n_draws")


@add("B04_source_mean_interval", f"""with u as (select user_id, median(value) as v from events where user_id is not null group by 1), {_drawn('select user_id from u where v is not null', 'user_id', 200, 304)},
e as (select draw, sum(w * v) / sum(w) as m from drawn join u using (user_id) group by 1)
select (select count(v) from u) as n, (select count(*) from u where v is null) as n_missing, round((select avg(v) from u), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from e""")
def b04(spark, sf):
    """Interval of the mean of users' medians."""
    each = table(spark, sf, "events").where("user_id is not null").groupBy("user_id").agg(F.median("value").alias("v"))
    out = resample.source_mean_interval(each, "user_id", "v", 200, 304)
    return out.select("n", "n_missing", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


QUERIES, ORACLE_SQL = catalogue.queries, catalogue.sql
