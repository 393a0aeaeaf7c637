"""Grouped summaries, classification counts and paired joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.scalar import ratio
from assayer.operators import classify, grouped, joins
from assayer.plans.registry import Catalogue, table

catalogue = Catalogue()
add = catalogue.add


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@add("A01_numeric_summary", "select o_orderpriority, " + ", ".join(f"round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 4) as {c}_std, count({c}) as {c}_count" for c in ("o_orderkey", "o_custkey", "o_totalprice")) + " from orders group by 1")
def a01(spark, sf):
    out = grouped.numeric_summary(table(spark, sf, "orders"), ["o_orderpriority"])
    return rounded(rounded(out, *(c for c in out.columns if c.endswith("_mean"))), *(c for c in out.columns if c.endswith("_std")), digits=4)


_SPREAD = "count({0}) as n, round(avg({0}), 6) as mean, round(stddev_samp({0}), 6) as std, round(quantile_cont({0}, 0.05), 6) as p05, round(quantile_cont({0}, 0.5), 6) as median, round(quantile_cont({0}, 0.95), 6) as p95"


@add("A02_value_spread", f"select event_type, {_SPREAD.format('value')} from events group by 1")
def a02(spark, sf):
    return rounded(grouped.spread(table(spark, sf, "events"), ["event_type"], "value"), "mean", "std", "p05", "median", "p95")


_DELTA = "with f as (select l_orderkey, l_returnflag as flag, sum(round(l_extendedprice * 100)::bigint)::bigint as v from lineitem group by 1, 2), d as (select f.flag, f.l_orderkey, f.v - r.v as delta from f join f r using (l_orderkey) where r.flag = 'N' and f.flag <> 'N')"


def _flags(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("flag")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("v"))


@add("A03_paired_delta_report", f"{_DELTA} select flag, {_SPREAD.format('delta')}, abs(avg(delta)) > 100 as shifted from d group by 1")
def a03(spark, sf):
    """Spread of each return flag's price difference to flag N within the same order."""
    d = joins.with_reference(_flags(spark, sf), "l_orderkey", "flag", "N", "v")
    out = grouped.spread(d, ["flag"], "delta").withColumn("shifted", F.abs("mean") > 100)
    return rounded(out, "mean", "std", "p05", "median", "p95")


@add("J03_with_reference", f"{_DELTA} select flag, l_orderkey, delta from d")
def j03(spark, sf):
    d = joins.with_reference(_flags(spark, sf), "l_orderkey", "flag", "N", "v")
    return d.select("flag", "l_orderkey", "delta")


@add("J04_paired_deltas", "select e.user_id, e.event_type, round(e.m - r.m, 6) as delta from (select user_id, event_type, avg(value) as m from events group by 1, 2) e join (select user_id, avg(value) as m from events where event_type = 'view' group by 1) r using (user_id) where e.event_type <> 'view'")
def j04(spark, sf):
    m = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    return joins.with_reference(m, "user_id", "event_type", "view", "m").select("user_id", "event_type", F.round("delta", 6).alias("delta"))


@add("A04_first_known", "select user_id, arg_min(event_type, event_id) filter (where event_type is not null) as event_type, arg_min(value, event_id) filter (where value is not null) as value from events group by 1")
def a04(spark, sf):
    return grouped.first_known(table(spark, sf, "events"), ["user_id"], "event_id", ["event_type", "value"])


@add("A05_text_report", "select o_orderstatus, printf('%.5f', avg(o_totalprice)) as mean_text, printf('%.5f', max(o_totalprice)) as max_text from orders group by 1")
def a05(spark, sf):
    return grouped.strength(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice")


@add("A06_distribution", "select l_shipmode, count(*) as n from (select l_returnflag as l_shipmode, l_quantity from lineitem) group by 1".replace("count(*) as n", "count(l_quantity) as n, min(l_quantity) as low, round(quantile_cont(l_quantity, 0.05), 6) as p05, round(median(l_quantity), 6) as median, round(quantile_cont(l_quantity, 0.95), 6) as p95, max(l_quantity) as high, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as std_pop").replace("l_shipmode", "flag"))
def a06(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    return rounded(grouped.distribution(rows, ["flag"], "l_quantity"), "p05", "median", "p95", "mean", "std_pop")


_PRED = "(select l.quality as truth, case when d.n_chars > 800 then 1 else 0 end as predicted, d.lang, case when l.toxic is null then -1 else l.toxic end as toxic from documents d join labels l using (doc_id))"


def _predicted(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.select(F.col("quality").alias("truth"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("predicted"), "lang", "toxic")


_CELLS = "count(*) filter (where truth = 1 and predicted = 1) as tp, count(*) filter (where truth = 0 and predicted = 1) as fp, count(*) filter (where truth = 0 and predicted = 0) as tn, count(*) filter (where truth = 1 and predicted = 0) as fn"
_RATES = "round(tp / nullif(tp + fp, 0)::double, 9) as precision, round(tp / nullif(tp + fn, 0)::double, 9) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 9) as f1, round(tp / nullif(tp + fp + fn, 0)::double, 9) as iou, round(fp / nullif(fp + tn, 0)::double, 9) as fpr"


@add("A14_confusion", f"select lang, {_CELLS} from {_PRED} group by 1")
def a14(spark, sf):
    return classify.confusion(_predicted(spark, sf), ["lang"], "truth", "predicted")


@add("A15_rates", f"select lang, tp, fp, tn, fn, {_RATES} from (select lang, {_CELLS} from {_PRED} group by 1)")
def a15(spark, sf):
    out = classify.rates(classify.confusion(_predicted(spark, sf), ["lang"], "truth", "predicted"))
    return rounded(out, "precision", "recall", "f1", "iou", "fpr", digits=9)


_GRID = f"(select t.v as truth, p.v as predicted, count(x.truth) as n from (select unnest([0, 1]) as v) t cross join (select unnest([0, 1]) as v) p left join {_PRED} x on x.truth = t.v and x.predicted = p.v group by 1, 2)"


@add("A17_confusion_matrix", f"select * from {_GRID}")
def a17(spark, sf):
    labels = spark.createDataFrame([(0,), (1,)], "label int")
    return classify.matrix(_predicted(spark, sf), "truth", "predicted", labels)


@add("A17b_matrix_with_abstention", """select t.v as truth, p.v as predicted, count(x.truth) as n from (select unnest([0, 1, 2]) as v) t cross join (select unnest([0, 1, 2, -1]) as v) p
left join (select label as truth, case when vec_id % 5 = 0 then -1 else (label + vec_id % 2) % 3 end as predicted from embeddings where label < 3) x on x.truth = t.v and x.predicted = p.v group by 1, 2""")
def a17b(spark, sf):
    rows = table(spark, sf, "embeddings").where("label < 3").select(F.col("label").alias("truth"), F.when(F.col("vec_id") % 5 == 0, -1).otherwise((F.col("label") + F.col("vec_id") % 2) % 3).cast("int").alias("predicted"))
    return classify.matrix(rows, "truth", "predicted", spark.createDataFrame([(0,), (1,), (2,)], "label int"), abstained=True)


_SCORES = f"""(with m as {_GRID}, r as (select truth as label, sum(n)::bigint as support, coalesce(sum(n) filter (where truth = predicted), 0)::bigint as hit from m group by 1), c as (select predicted as label, sum(n)::bigint as called from m group by 1)
select label, support, hit / nullif(called, 0)::double as precision, hit / nullif(support, 0)::double as recall, coalesce(2 * hit / nullif(support + called, 0)::double, 0.0) as f1 from r join c using (label))"""


@add("A18_class_scores", f"select label, support, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1 from {_SCORES}")
def a18(spark, sf):
    return rounded(classify.class_scores(a17(spark, sf)), "precision", "recall", "f1", digits=9)


@add("A21_macro_both_policies", f"select round(avg(precision), 9) as macro, round(avg(coalesce(precision, 0)), 9) as macro_zero, count(*) as n_groups from (select lang, sum(case when truth = 1 and predicted = 1 then 1 end)::double / nullif(count(*) filter (where predicted = 1 and lang <> 'de'), 0) as precision from {_PRED} group by 1)")
def a21(spark, sf):
    """Means over groups of which one has no defined value."""
    part = _predicted(spark, sf).groupBy("lang").agg(F.count_if((F.col("truth") == 1) & (F.col("predicted") == 1)).alias("tp"), F.count_if((F.col("predicted") == 1) & (F.col("lang") != "de")).alias("called"))
    return rounded(classify.macro(part.select(ratio(F.col("tp"), F.col("called")).alias("p")), "p"), "macro", "macro_zero", digits=9)


@add("A22_value_counts", "select event_type, user_id % 3 as part, count(*) as n from events group by 1, 2")
def a22(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 3).alias("part")).agg(F.count("*").alias("n"))


@add("A23_two_level_table", "select lang, count(*) filter (where source = 'src0') as src0, count(*) filter (where source = 'src1') as src1 from documents where lang in (select lang from documents where source in ('src0', 'src1')) group by 1")
def a23(spark, sf):
    rows = table(spark, sf, "documents").where(F.col("source").isin("src0", "src1"))
    return grouped.table(rows, "lang", "source", ["src0", "src1"])


@add("A24_distinct_counts", "select o_orderpriority, count(distinct o_custkey) as n_customers, count(distinct o_orderstatus) as n_states from orders group by 1")
def a24(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_customers"), F.count_distinct("o_orderstatus").alias("n_states"))


@add("A25_mode_share", "select user_id, event_type as mode, n, round(n::double / t, 9) as share from (select user_id, event_type, count(*) as n, sum(count(*)) over (partition by user_id) as t, row_number() over (partition by user_id order by count(*) desc, event_type) as k from events where event_type is not null group by 1, 2) where k = 1")
def a25(spark, sf):
    return rounded(grouped.mode_share(table(spark, sf, "events"), ["user_id"], "event_type"), "share", digits=9)


@add("A28_weighted_histogram", "select event_type, least(floor(value / 500 * 20), 19)::int as bin, count(*) as mass from events where value between 0 and 500 group by 1, 2")
def a28(spark, sf):
    return grouped.histogram(table(spark, sf, "events"), ["event_type"], F.col("value") / 500, F.lit(1))


@add("A29_top_share", "select (select sum(v) from (select count(*) as v from lineitem group by l_suppkey order by v desc, l_suppkey limit 10))::bigint as in_top, count(*) as total, round((select sum(v) from (select count(*) as v from lineitem group by l_suppkey order by v desc, l_suppkey limit 10))::double / count(*), 9) as share from lineitem")
def a29(spark, sf):
    return rounded(grouped.top_share(table(spark, sf, "lineitem"), "l_suppkey", F.lit(1)), "share", digits=9)


@add("A30_variance_split", "select event_type, count(*) as n_groups, round(var_pop(m), 6) as between, round(avg(v), 6) as within from (select event_type, user_id, avg(value) as m, var_pop(value) as v from events group by 1, 2) group by 1".replace("as between", 'as "between"'))
def a30(spark, sf):
    return rounded(grouped.variance_split(table(spark, sf, "events"), ["event_type"], "user_id", "value"), "between", "within")


@add("A32_win_share", "select l_returnflag, count(*) as n_sources, round(avg(w), 9) as win from (select l_returnflag, l_suppkey, avg(case when l_quantity > 25 then 1.0 when l_quantity = 25 then 0.5 else 0.0 end) as w from lineitem group by 1, 2) group by 1")
def a32(spark, sf):
    return rounded(grouped.win_share(table(spark, sf, "lineitem"), ["l_returnflag"], "l_suppkey", F.col("l_quantity") - 25), "win", digits=9)


@add("A34_mass_by_strata", "select event_type, u as part, grouping(event_type, u)::int as level, count(*) as n, sum(w)::bigint as mass from (select event_type, user_id % 4 as u, user_id as w from events) group by grouping sets ((event_type, u), (event_type), ())")
def a34(spark, sf):
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 4).alias("part"), "user_id")
    return grouped.stratum_mass(rows, [["event_type", "part"], ["event_type"], []], F.col("user_id"))


@add("A36_dataset_summary", "select source, count(*) as n, sum(n_chars)::bigint as chars, count(*) filter (where lang = 'en') as en, count(*) filter (where lang <> 'en') as other, greatest(0, 60 - count(*)) as shortfall from documents group by 1")
def a36(spark, sf):
    en = F.count_if(F.col("lang") == "en")
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), en.alias("en"), F.count_if(F.col("lang") != "en").alias("other"), F.greatest(F.lit(0).cast("long"), 60 - F.count("*")).alias("shortfall"))


@add("A37_collapse_point", "select event_type, max(cut) filter (where share >= 0.3) as collapse from (select event_type, cut, count(*) filter (where value > cut)::double / count(*) as share from events, (select unnest([10, 50, 100, 200, 400]) as cut) group by 1, 2) group by 1")
def a37(spark, sf):
    cuts = spark.createDataFrame([(c,) for c in (10, 50, 100, 200, 400)], "cut int")
    share = table(spark, sf, "events").crossJoin(F.broadcast(cuts)).groupBy("event_type", "cut").agg((F.count_if(F.col("value") > F.col("cut")) / F.count("*")).alias("share"))
    return grouped.collapse_point(share, ["event_type"], "cut", "share", 0.3)


@add("A41_window_counts", "select count(*) filter (where label = -1) as n_ignored, count(*) filter (where label = 0) as n_zero, count(*) filter (where label = 1) as n_one, count(distinct doc_id) as n_docs from (select d.doc_id, coalesce(l.quality, -1) as label from documents d left join labels l using (doc_id))")
def a41(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("label"))
    return rows.agg(*(F.count_if(F.col("label") == v).alias(n) for v, n in ((-1, "n_ignored"), (0, "n_zero"), (1, "n_one"))), F.count_distinct("doc_id").alias("n_docs"))


@add("J01_full_outer_metrics", "select coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey, a.n as n_returned, b.n as n_large from (select l_suppkey, count(*) as n from lineitem where l_returnflag = 'R' and l_suppkey % 3 <> 0 group by 1) a full outer join (select l_suppkey, count(*) as n from lineitem where l_quantity > 45 and l_suppkey % 5 <> 0 group by 1) b on a.l_suppkey = b.l_suppkey")
def j01(spark, sf):
    rows = table(spark, sf, "lineitem")
    a = rows.where("l_returnflag = 'R' and l_suppkey % 3 <> 0").groupBy("l_suppkey").agg(F.count("*").alias("n_returned"))
    b = rows.where("l_quantity > 45 and l_suppkey % 5 <> 0").groupBy("l_suppkey").agg(F.count("*").alias("n_large"))
    return joins.side_by_side(a, b, ["l_suppkey"])


@add("J02_quality_by_detection", "select q.condition, q.mean, d.n_over from (select event_type as condition, round(avg(value), 6) as mean from events group by 1) q join (select event_type as condition, count(*) filter (where value > 100) as n_over from events where user_id % 2 = 0 group by 1) d using (condition)")
def j02(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "condition")
    q = e.groupBy("condition").agg(F.round(F.avg("value"), 6).alias("mean"))
    d = e.where("user_id % 2 = 0").groupBy("condition").agg(F.count_if(F.col("value") > 100).alias("n_over"))
    return q.join(d, "condition")


@add("J06_shared_positions", "select l_partkey % 50 as g, l_linenumber as pos from lineitem where l_returnflag in ('A', 'R') and l_quantity > 10 group by 1, 2 having count(distinct l_returnflag) = 2 qualify count(*) over (partition by l_partkey % 50) >= 5")
def j06(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("g"), F.col("l_linenumber").alias("pos"), "l_returnflag", "l_quantity")
    return joins.shared_positions(rows, "g", "pos", "l_returnflag", ["A", "R"], F.col("l_quantity") > 10, 5)


@add("J07_contrast", "select o_orderpriority, round(f, 6) as full_value, round(l, 6) as limited_value, round(f - l, 6) as delta from (select o_orderpriority, max(v) filter (where o_orderstatus = 'F') as f, max(v) filter (where o_orderstatus = 'O') as l from (select o_orderpriority, o_orderstatus, avg(o_totalprice) as v from orders group by 1, 2) group by 1) where f is not null and l is not null")
def j07(spark, sf):
    m = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    out = joins.contrast(m, ["o_orderpriority"], "o_orderstatus", "F", "O", "v")
    return out.select("o_orderpriority", F.round("full", 6).alias("full_value"), F.round("limited", 6).alias("limited_value"), F.round("delta", 6).alias("delta"))


@add("J08_side_by_side_pivot", "select user_id, arg_min(value, event_id) filter (where event_type = 'view') as \"view\", arg_min(value, event_id) filter (where event_type = 'click') as click from events group by 1")
def j08(spark, sf):
    return joins.pivoted(table(spark, sf, "events"), ["user_id"], "event_type", ["view", "click"], "value", "event_id")


@add("J09_matched_controls", """with one as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as k from customer), s as (select s_nationkey, count(*) as n_suppliers from supplier group by 1)
select c_nationkey, c_custkey, n_suppliers from one join s on s_nationkey = c_nationkey where k = 1 order by (n_suppliers = 1) desc, c_nationkey limit 8""")
def j09(spark, sf):
    controls = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n_suppliers"))
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.col("c_custkey").alias("pick"))
    return joins.matched_controls(rows, controls, "c_nationkey", F.col("n_suppliers") == 1, 8).select("c_nationkey", "c_custkey", "n_suppliers")


@add("J10_excluded_with_reason", "select d.doc_id, case when d.n_chars < 200 then 'short' else 'unlabelled' end as reason from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def j10(spark, sf):
    left = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti")
    return left.select("doc_id", F.when(F.col("n_chars") < 200, "short").otherwise("unlabelled").alias("reason"))


@add("J12_donors", "select s.s_suppkey, c.condition, substr(sha256(s.s_suppkey || '|' || c.condition), 1, 24) as donor_id, n.n_name from supplier s cross join (select unnest(['a', 'b', 'control']) as condition) c join nation n on n.n_nationkey = s.s_nationkey")
def j12(spark, sf):
    sources = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return joins.donors(table(spark, sf, "supplier"), sources, "s_suppkey", ["a", "b", "control"]).select("s_suppkey", "condition", "donor_id", "n_name")


@add("F03_membership_filter", "select event_type, count(*) as n from events where event_type <> 'view' and (event_type, user_id % 10) not in (select 'click', 3) group by 1")
def f03(spark, sf):
    excluded = spark.createDataFrame([("click", 3)], "event_type string, part long")
    rows = table(spark, sf, "events").where("event_type <> 'view'").withColumn("part", F.col("user_id") % 10)
    return rows.join(F.broadcast(excluded), ["event_type", "part"], "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


@add("F05_effective_band", "select s_suppkey, coalesce(case when s_acctbal > 0 then s_acctbal end, case when s_nationkey % 2 = 0 then 22050 else 16000 end / 2) as band from supplier")
def f05(spark, sf):
    half = F.element_at(F.create_map(F.lit(0), F.lit(22050.0), F.lit(1), F.lit(16000.0)), F.col("s_nationkey") % 2) / 2
    return table(spark, sf, "supplier").select("s_suppkey", F.coalesce(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")), half).alias("band"))


@add("F11_activity_bins", "select event_type, case when value < 10 then 0 when value < 100 then 1 else 2 end as bin, count(*) as n from events where value is not null group by 1, 2")
def f11(spark, sf):
    from assayer.operators.intervals import activity

    return table(spark, sf, "events").where("value is not null").groupBy("event_type", activity(F.col("value"), 10).alias("bin")).agg(F.count("*").alias("n"))


@add("F14_probe_verdict", "select condition, round(m, 6) as m, m < 100 and condition <> 'purchase' as leaked from (select event_type as condition, avg(value) as m from events group by 1)")
def f14(spark, sf):
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("condition")).agg(F.avg("value").alias("m"))
    return m.select("condition", F.round("m", 6).alias("m"), ((F.col("m") < 100) & (F.col("condition") != "purchase")).alias("leaked"))


QUERIES, ORACLE_SQL = catalogue.queries, catalogue.sql
