"""Folds, samples and weights by digest order."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import sampling as S
from assayer.plans.registry import Catalogue, table

catalogue = Catalogue()
add = catalogue.add
_H = "sha256('7:{0}:' || {1})"
_FOLDS = f"(select user_id, (row_number() over (order by {_H.format('fold', 'user_id')}, user_id) - 1) % 5 as fold from (select distinct user_id from events where user_id is not null))"


def _long(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@add("O01_hash_order", f"select c_custkey, row_number() over (order by {_H.format('rank', 'c_custkey')}, c_custkey) as rank from customer")
def o01(spark, sf):
    return _long(S.ranked(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "rank", 7), "rank")


@add("T11_group_folds", f"select * from {_FOLDS}")
def t11(spark, sf):
    return _long(S.folds(table(spark, sf, "events"), "user_id", 5, "fold", 7), "fold")


@add("T12_nested_parts", f"""select user_id, case when row_number() over (order by {_H.format('nest', 'user_id')}, user_id) % 3 = 0 then 'calibration' else 'fit' end as part from {_FOLDS} where fold <> 2
union all select user_id, 'held' from {_FOLDS} where fold = 2""")
def t12(spark, sf):
    return S.nested(S.folds(table(spark, sf, "events"), "user_id", 5, "fold", 7), "user_id", 2, "nest", 7)


@add("T13_inner_hold_out", f"select user_id from (select user_id, row_number() over (order by {_H.format('inner', 'user_id')}, user_id) as k, count(*) over () as n from (select distinct user_id from events)) where k <= ceil(n * 0.2)")
def t13(spark, sf):
    return S.inner_hold_out(table(spark, sf, "events"), "user_id", 0.2, "inner", 7)


@add("T14_out_of_fold_once", f"select f.fold, count(*) as n, count(distinct e.event_id) as n_distinct from events e join {_FOLDS} f using (user_id) group by 1")
def t14(spark, sf):
    e = table(spark, sf, "events")
    return _long(e.join(S.folds(e, "user_id", 5, "fold", 7), "user_id"), "fold").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct"))


@add("O02_qualified_groups", f"""with z as (select o_custkey, count(*) as n from orders group by 1), g as (select o_custkey, row_number() over (order by {_H.format('q', 'o_custkey')}, o_custkey) as gk from z where n >= 15), m as (select count(*) as nf from g),
r as (select o.o_orderkey, o.o_custkey, z.n, g.gk, m.nf, row_number() over (partition by o.o_custkey order by {_H.format('q', 'o.o_orderkey')}, o.o_orderkey) as ik from orders o join z using (o_custkey) left join g using (o_custkey) cross join m)
select o_orderkey, o_custkey, case when n < 15 then 'group_too_small' when nf < 20 then 'shortfall' when gk > 20 then 'group_not_drawn' when ik > 10 then 'item_not_drawn' else 'selected' end as decision from r""")
def o02(spark, sf):
    return S.qualified(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 20, 15, "q", 7, take=10)


@add("O03_round_robin", "select event_type, event_id, k as turn_no from (select event_type, event_id, row_number() over (partition by event_type order by event_id) as k from events) order by k, event_type limit 20")
def o03(spark, sf):
    return _long(S.round_robin(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 20), "turn_no")


@add("O04_quota", f"""with r as (select event_type, event_id, value > 20 as ok, row_number() over (partition by event_type, value > 20 order by {_H.format('quota', 'event_id')}, event_id) as k from events where value is not null)
select event_type, event_id, case when ok then k end as rank, case when not ok then 'ineligible' when k <= 25 then 'selected' else 'over_quota' end as reason from r""")
def o04(spark, sf):
    rows = table(spark, sf, "events").where("value is not null").select("event_type", "event_id", "value")
    return _long(S.quota(rows, "event_type", "event_id", F.col("value") > 20, 25, "quota", 7), "rank").drop("value")


@add("O05_groups_per_fold", f"select fold, user_id from (select fold, user_id, row_number() over (partition by fold order by {_H.format('pick', 'user_id')}, user_id) as k from {_FOLDS}) where k <= 4")
def o05(spark, sf):
    return _long(S.capped(S.folds(table(spark, sf, "events"), "user_id", 5, "fold", 7), ["fold"], "user_id", 4, "pick", 7), "fold").select("fold", "user_id")


@add("O06_capped_sample", f"select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by {_H.format('cap', 'event_id')}, event_id) as k from events) where k <= 3")
def o06(spark, sf):
    return S.capped(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", 3, "cap", 7).select("user_id", "event_type", "event_id")


@add("O07_balanced_sample", f"""with x as (select d.lang, d.doc_id, l.quality as y from documents d join labels l using (doc_id)), n as (select lang, least(count(*) filter (where y = 0), count(*) filter (where y = 1), 24) as n from x group by 1)
select lang, doc_id, y from (select x.*, n.n, row_number() over (partition by lang, y order by {_H.format('bal', 'doc_id')}, doc_id) as k from x join n using (lang)) where k <= n""")
def o07(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", "doc_id", F.col("quality").alias("y"))
    return S.balanced(rows, ["lang"], "y", "doc_id", 24, "bal", 7)


@add("O08_frozen_split", f"""select c_custkey, case when k <= round_even(n * 0.7, 0) then 'train' when k <= round_even(n * 0.7, 0) + round_even(n * 0.1, 0) then 'dev' else 'eval' end as split
from (select c_custkey, row_number() over (order by {_H.format('split', 'c_custkey')}, c_custkey) as k, count(*) over () as n from customer)""")
def o08(spark, sf):
    return S.frozen_split(table(spark, sf, "customer"), "c_custkey", {"train": 0.7, "dev": 0.1, "eval": 0.2}, "split", 7)


@add("O09_strided", "select event_id, value from events where event_id % 16 = 0")
def o09(spark, sf):
    return S.strided(table(spark, sf, "events"), "event_id", 16).select("event_id", "value")


@add("O10_limited_units", "select l_orderkey, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders order by o_orderkey limit 50) group by 1")
def o10(spark, sf):
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")).orderBy("l_orderkey").limit(50)
    return table(spark, sf, "lineitem").join(units, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@add("T09_class_weights", "select label, n, round(t::double / (k * n), 9) as weight from (select label, count(*) as n, sum(count(*)) over () as t, count(*) over () as k from embeddings group by 1)")
def t09(spark, sf):
    return S.class_weights(table(spark, sf, "embeddings"), "label").withColumn("weight", F.round("weight", 9))


_MASS = "(select l_suppkey % 20 as g, l_returnflag = 'N' as matched, l_linenumber::double as w, sum(l_linenumber) over p as t, sum(case when l_returnflag = 'N' then l_linenumber else 0 end) over p as o from lineitem window p as (partition by l_suppkey % 20))"


@add("T10_matched_mass", f"select g, matched, round(sum(nw), 6) as mass, round(sum(nw) * sum(nw) / sum(nw * nw), 6) as effective from (select *, case when o = 0 or o = t then w when matched then w * 0.25 * t / o else w * 0.75 * t / (t - o) end as nw from {_MASS}) group by 1, 2")
def t10(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("g"), (F.col("l_returnflag") == "N").alias("matched"), F.col("l_linenumber").cast("double").alias("w"))
    w = F.col("new_weight")
    return S.matched_mass(rows, ["g"], "matched", "w", 0.25).groupBy("g", "matched").agg(F.round(F.sum(w), 6).alias("mass"), F.round(F.sum(w) * F.sum(w) / F.sum(w * w), 6).alias("effective"))


@add("T06_constrained_choice", "select event_type, coalesce((select c::varchar from (select unnest([50, 100, 200, 400]) as c) k where (select count(*) from events x where x.event_type = e.event_type and x.value > k.c) <= 0.2 * (select count(*) from events x where x.event_type = e.event_type) order by c limit 1), 'reject_all') as choice from (select distinct event_type from events) e")
def t06(spark, sf):
    """The smallest cut that keeps a type's flagged share at 20 % or less; reject_all where none does."""
    cuts = spark.createDataFrame([(c,) for c in (50, 100, 200, 400)], "cut int")
    e = table(spark, sf, "events")
    share = e.crossJoin(F.broadcast(cuts)).groupBy("event_type", "cut").agg(F.count_if(F.col("value") > F.col("cut")).alias("k"), F.count("*").alias("n"))
    fit = S.best(share.where("k <= 0.2 * n"), ["event_type"], F.col("cut"))
    return e.select("event_type").distinct().join(fit, "event_type", "left").select("event_type", F.coalesce(F.col("cut").cast("string"), F.lit("reject_all")).alias("choice"))


@add("T15_capacity_tie_break", "select l_suppkey % 10 as g, l_returnflag as name from (select l_suppkey, l_returnflag, count(*) as n from lineitem group by l_suppkey % 10, l_suppkey, l_returnflag) group by 1, 2 qualify row_number() over (partition by l_suppkey % 10 order by max(n) desc, min(n), l_returnflag) = 1")
def t15(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("g"), "l_suppkey", F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n")).groupBy("g", "name").agg(F.max("n").alias("most"), F.min("n").alias("least"))
    return S.best(rows, ["g"], F.desc("most"), F.col("least"), F.col("name")).select("g", "name")


@add("M09_leave_one_out", "select a.event_type as held, b.event_type as trained from (select distinct event_type from events) a, (select distinct event_type from events) b where a.event_type <> b.event_type")
def m09(spark, sf):
    kinds = table(spark, sf, "events").select("event_type").distinct()
    return kinds.select(F.col("event_type").alias("held")).crossJoin(kinds.select(F.col("event_type").alias("trained"))).where("held <> trained")


QUERIES, ORACLE_SQL = catalogue.queries, catalogue.sql
