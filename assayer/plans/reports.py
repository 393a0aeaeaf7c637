"""Composed reports: bundles of metrics, source-level scores, activity strata, gates and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.scalar import ratio
from assayer.operators import classify, constraints, grouped, joins, ranking, sampling
from assayer.operators import intervals as I
from assayer.operators import selection as S
from assayer.operators.ordered import joined, quantiles
from assayer.plans import grouped as G
from assayer.plans import intervals as W
from assayer.plans import ranking as R
from assayer.plans.registry import Catalogue, table

catalogue = Catalogue()
add = catalogue.add
_PRED = G._PRED


@add("A16_metrics_bundle", f"""with c as (select lang, {G._CELLS} from {_PRED} group by 1), x as (select d.lang as condition, -d.n_chars as score, l.quality = 0 as is_ref from documents d join labels l using (doc_id)),
a as (select condition, count(*) filter (where is_ref) as np, count(*) filter (where not is_ref) as nn, sum(r) filter (where is_ref) as s from (select *, rank() over (partition by condition order by score) + (count(*) over (partition by condition, score) - 1) / 2.0 as r from x) group by 1)
select lang, tp, fp, tn, fn, round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 9) as f1, round(case when np > 0 and nn > 0 then (s - np * (np + 1) / 2.0) / (np::double * nn) end, 9) as auroc from c join a on a.condition = c.lang""")
def a16(spark, sf):
    """Counts and rates with the area on negated scores, by language."""
    rates = classify.rates(classify.confusion(G._predicted(spark, sf), ["lang"], "truth", "predicted"))
    negated = R._lengths(spark, sf).select(F.col("condition").alias("lang"), (-F.col("score")).alias("score"), (~F.col("is_ref")).alias("poor"))
    area = ranking.auroc(negated, ["lang"], "score", F.col("poor"))
    return rates.join(area, "lang").select("lang", "tp", "fp", "tn", "fn", F.round("f1", 9).alias("f1"), F.round("auroc", 9).alias("auroc"))


@add("A20_error_rates_at_threshold", "select condition, n_ref, n_other, round(missed::double / n_ref, 9) as frr, round(accepted::double / n_other, 9) as far from (select condition, count(*) filter (where is_ref) as n_ref, count(*) filter (where not is_ref) as n_other, count(*) filter (where is_ref and score <= 30) as missed, count(*) filter (where not is_ref and score > 30) as accepted from (" + R._PAIRS + " select * from x) group by 1)")
def a20(spark, sf):
    out = classify.error_rates(R._events(spark, sf), ["condition"], "score", "is_ref", 30, "n")
    return out.select("condition", "n_ref", "n_other", F.round("frr", 9).alias("frr"), F.round("far", 9).alias("far"))


@add("A26_modal_lag_gate", """with d as (select l_suppkey % 10 as condition, l_linenumber - 3 as lag from lineitem), m as (select condition, lag, count(*) as n, row_number() over (partition by condition order by count(*) desc, lag) as k, sum(count(*)) over (partition by condition) as t from d group by 1, 2)
select condition, lag as modal_lag, t::bigint as n_pairs, round(n::double / t, 9) as share, t >= 20 and lag = 0 as aligned from m where k = 1""")
def a26(spark, sf):
    """A condition is aligned with 20 pairs or more whose modal lag is 0."""
    d = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("condition"), (F.col("l_linenumber") - 3).alias("lag"))
    m = grouped.mode_share(d, ["condition"], "lag")
    total = d.groupBy("condition").agg(F.count("*").alias("n_pairs"))
    return m.join(total, "condition").select("condition", F.col("mode").alias("modal_lag"), "n_pairs", F.round("share", 9).alias("share"), ((F.col("n_pairs") >= 20) & (F.col("mode") == 0)).alias("aligned"))


@add("A31_source_scores", """select event_type, bin, count(*) as n, count(distinct user_id) as n_sources, round(avg(value), 6) as mean from (select *, case when value < 10 then 0 when value < 100 then 1 else 2 end as bin from events where value is not null) group by grouping sets ((event_type, bin), (event_type))""")
def a31(spark, sf):
    rows = table(spark, sf, "events").where("value is not null").withColumn("bin", I.activity(F.col("value"), 10))
    return S.by_and_over_all(rows, ["event_type"], "bin", F.count("*").alias("n"), F.count_distinct("user_id").alias("n_sources"), F.round(F.avg("value"), 6).alias("mean"))


@add("A33_band_summary", "select label, band::int as band, count(*) as n, round(avg(x), 6) as mean, round(median(x), 6) as median from (select label, unnest(range(64)) as band, unnest(list_transform(embedding, lambda v: v::double)) as x from embeddings) group by 1, 2")
def a33(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("band", "v")).select("label", "band", F.col("v").cast("double").alias("x"))
    middle = quantiles(rows, ["label", "band"], "x", {"median": 0.5}).drop("n")
    out = joined(rows.groupBy("label", "band").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), middle, ["label", "band"])
    return out.select("label", "band", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@add("A35_counts_with_empty_cells", "select l.lang, s.source, count(d.doc_id) as n from (select distinct lang from documents) l cross join (select distinct source from documents) s left join documents d on d.lang = l.lang and d.source = s.source and d.n_chars > 2000 group by 1, 2")
def a35(spark, sf):
    return S.counts_of_all(table(spark, sf, "documents"), "lang", "source", F.col("n_chars") > 2000)


@add("A38_audit_table", "select s_suppkey, case when s_acctbal is null then 'missing' when s_acctbal < 0 then 'refused' when s_acctbal < 1000 then 'pending' else 'ready' end as status from supplier")
def a38(spark, sf):
    name = S.status(F.col("s_acctbal"), [(0, "refused"), (1000, "pending")], "ready")
    return table(spark, sf, "supplier").select("s_suppkey", name.alias("status"))


@add("A39_merge_summary", "select d.doc_id, coalesce(l.quality, -1) as quality, l.doc_id is null as missing_sidecar from documents d left join labels l using (doc_id)")
def a39(spark, sf):
    out = S.with_sidecar(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", {"quality": -1})
    return out.select("doc_id", "quality", "missing_sidecar")


@add("A40_metrics_at_oracle_cutoff", R._CUT + """, m as (select max(boundary) as b from k) select e.event_type as kind, count(*) filter (where e.value > m.b) as flagged, count(*) as n, round(count(*) filter (where e.value > m.b)::double / count(*), 9) as share from events e, m where e.value is not null group by 1""")
def a40(spark, sf):
    """Every kind's flagged share at the strictest cut of the two control kinds."""
    rows = table(spark, sf, "events").withColumnRenamed("event_type", "kind")
    cut = ranking.control_cutoff(rows.where(F.col("kind").isin("view", "click")), ["kind"], "value", F.lit(1), 0.05).agg(F.max("boundary").alias("b"))
    return S.share_over(rows, ["kind"], "value", cut).withColumn("share", F.round("share", 9))


@add("A42_mean_or_null", "select avg(value) filter (where event_type = 'nothing') as none, round(avg(value), 6) as mean from events")
def a42(spark, sf):
    return table(spark, sf, "events").agg(F.avg(F.when(F.col("event_type") == "nothing", F.col("value"))).alias("none"), F.round(F.avg("value"), 6).alias("mean"))


@add("A43_selection_bias", "select admitted, count(*) as n, round(avg(n_chars), 6) as mean_chars, round(avg(length(text)::double), 6) as mean_length from (select *, doc_id in (select doc_id from labels where quality = 1) as admitted from documents) group by 1")
def a43(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1")
    out = S.compared(table(spark, sf, "documents"), good, "doc_id", mean_chars=F.col("n_chars"), mean_length=F.length("text"))
    return out.select("admitted", "n", F.round("mean_chars", 6).alias("mean_chars"), F.round("mean_length", 6).alias("mean_length"))


@add("C20_array_contract", "select vec_id, case when len(embedding) <> 64 then 'length' when list_max(list_transform(embedding, lambda x: abs(x))) > 0.35 then 'peak' end as reason from embeddings where len(embedding) <> 64 or list_max(list_transform(embedding, lambda x: abs(x))) > 0.35")
def c20(spark, sf):
    return S.array_faults(table(spark, sf, "embeddings"), "embedding", 64, 0.35).select("vec_id", "reason")


@add("C26_cohort_topology", "select count(*) as n, count(distinct s_suppkey) as n_keys, count(distinct s_name) as n_names, count(distinct s_suppkey) = count(*) and count(distinct s_name) = count(*) as unique_keys from supplier")
def c26(spark, sf):
    return S.topology(table(spark, sf, "supplier"), n_keys="s_suppkey", n_names="s_name")


@add("C28_stored_against_recomputed", """with s as (select o_orderpriority as p, avg(o_totalprice) as v from orders group by 1), r as (select p, case when p like '1%' then v * 1.5 else v end as v from s where p not like '5%')
select p, 'v' as "column", round(s.v, 6) as "left", round(r.v, 6) as "right" from s left join r using (p) where r.v is null or abs(s.v - r.v) > 1e-12 + 1e-12 * abs(r.v)""")
def c28(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.avg("o_totalprice").alias("v"))
    r = s.where("p not like '5%'").withColumn("v", F.when(F.col("p").startswith("1"), F.col("v") * 1.5).otherwise(F.col("v")))
    out = constraints.beyond_tolerance(s, r, ["p"], ["v"], 1e-12, 1e-12)
    return out.select("p", "column", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@add("F01_tier_selection", "select count(*) as n from orders where o_orderstatus = 'O'")
def f01(spark, sf):
    return S.tier(table(spark, sf, "orders"), "o_orderstatus", "O").agg(F.count("*").alias("n"))


@add("F04_refused_members", "select array_to_string(list_sort(list(distinct event_type)), ',') as offenders, count(*) as n from events where event_type in ('purchase', 'signup')")
def f04(spark, sf):
    members = spark.createDataFrame([("purchase",), ("signup",)], "event_type string")
    return S.refused(table(spark, sf, "events"), "event_type", members)


@add("F06_split_and_condition", "select lang, count(*) as n from documents where source = 'src1' and lang in ('en', 'de') group by 1")
def f06(spark, sf):
    return S.matching(table(spark, sf, "documents"), source="src1", lang=["en", "de"]).groupBy("lang").agg(F.count("*").alias("n"))


@add("F07_label_index", "select event_id, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 end as y from events where event_type in ('view', 'click', 'purchase')")
def f07(spark, sf):
    return S.label_index(table(spark, sf, "events"), "event_type", ["view", "click", "purchase"]).select("event_id", "y")


@add("F12_metric_difference", "select l_orderkey, l_linenumber, round(l_tax - l_discount, 6) as metric from lineitem")
def f12(spark, sf):
    """A metric named as a difference of two columns, checked against the schema before it is used."""
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(S.metric(rows, "l_tax-l_discount"), 6).alias("metric"))


@add("F16_path_filter", "select count(*) as n from pages where not list_has_any(string_split(url, '/'), ['cache', '1']) and url not like '%?%'")
def f16(spark, sf):
    return S.kept_paths(table(spark, sf, "pages"), "url", ["cache", "1"], ["?"]).agg(F.count("*").alias("n"))


@add("J11_row_identity", "select count(*) as n_missing from (select doc_id from labels except select doc_id from documents)")
def j11(spark, sf):
    return S.missing_keys(table(spark, sf, "labels"), table(spark, sf, "documents"), ["doc_id"]).agg(F.count("*").alias("n_missing"))


@add("T08_recommendation", "select event_type, case when d > 5 then 'A' when d > 0 then 'B' else 'C' end as choice from (select event_type, avg(value) - median(value) as d from events group by 1)")
def t08(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type").agg((F.avg("value") - F.median("value")).alias("d"))
    return d.select("event_type", S.recommended(F.col("d"), [(5, "A"), (0, "B")], "C").alias("choice"))


@add("T16_signal_gate", "select condition, auroc >= 0.5 and n_pos >= 10 as go_on from (" + R._LENGTHS.format("quality") + R._AUC + ")")
def t16(spark, sf):
    out = ranking.auroc(R._lengths(spark, sf), ["condition"], "score", F.col("is_ref")).withColumn("auroc", F.round("auroc", 9))
    return out.select("condition", ((F.col("auroc") >= 0.5) & (F.col("n_pos") >= 10)).alias("go_on"))


@add("W13_score_mass", f"select doc_id, sum((cell_end - cell_start) * ((window_idx * 7 + doc_id) % 10))::bigint as mass, sum(cell_end - cell_start)::bigint as covered from {W._CELLS} group by 1")
def w13(spark, sf):
    """A score over every position, as cells with their lengths."""
    width, score = F.col("cell_end") - F.col("cell_start"), (F.col("window_idx") * 7 + F.col("doc_id")) % 10
    return W._cells(spark, sf).groupBy("doc_id").agg(F.sum(width * score).alias("mass"), F.sum(width).alias("covered"))


_SCORED = f"(select c.doc_id, sum(case when r.label = 1 and p >= 0.6 then w else 0 end) as tp, sum(case when r.label = 0 and p >= 0.6 then w else 0 end) as fp, sum(case when r.label = 1 and p < 0.6 then w else 0 end) as fn from (select *, least(cell_end, run_end) - greatest(cell_start, run_start) as w from (select doc_id, cell_start, cell_end, (window_idx * 7 + doc_id) % 10 / 10.0 as p from {W._CELLS}) join {W._RUNS} r using (doc_id) where cell_start < run_end and run_start < cell_end) c join (select 1) on true, lateral (select c.label) r(label) group by 1)"


@add("W15_localization", f"select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::double, 9) as micro_f1, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)::double), 9) as macro_f1 from {_SCORED}")
def w15(spark, sf):
    """Positions found, by overlap of scored cells with labelled runs: over all and as a mean of documents."""
    both = W._cells(spark, sf).join(W._runs(spark, sf).drop("n_chars"), "doc_id").where("cell_start < run_end and run_start < cell_end")
    width = F.least("cell_end", "run_end") - F.greatest("cell_start", "run_start")
    hit = (F.col("window_idx") * 7 + F.col("doc_id")) % 10 >= 6
    cell = lambda c: F.sum(F.when(c, width).otherwise(0))
    each = both.groupBy("doc_id").agg(cell((F.col("label") == 1) & hit).alias("tp"), cell((F.col("label") == 0) & hit).alias("fp"), cell((F.col("label") == 1) & ~hit).alias("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    out = each.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg(f1), 9).alias("macro_f1"))
    return out.withColumn("micro_f1", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9))


@add("W22_strata_by_activity", "select event_type, user_id % 2 as assignment, case when value < 10 then 0 when value < 100 then 1 else 2 end as bin, count(*) as n from events where value is not null group by 1, 2, 3")
def w22(spark, sf):
    return table(spark, sf, "events").where("value is not null").groupBy("event_type", (F.col("user_id") % 2).alias("assignment"), I.activity(F.col("value"), 10).alias("bin")).agg(F.count("*").alias("n"))


@add("D02_probe_table", """select 'length' as probe, lang as condition, round(avg(n_chars), 6) as m from documents group by 2 union all select 'words', lang, round(avg(len(string_split(text, ' '))), 6) from documents group by 2""")
def d02(spark, sf):
    docs = table(spark, sf, "documents")
    out = S.probes(docs, F.col("lang"), "condition", length=F.col("n_chars"), words=F.size(F.split("text", " ")))
    return out.withColumn("m", F.round("m", 6))


@add("D05_headline_summary", """with q as (select event_type as condition, avg(value) as quality from events where event_type <> 'view' group by 1), d as (select event_type as condition, count(*) filter (where value > 50)::double / count(*) as detected from events group by 1),
r as (select rank() over (order by quality) + (count(*) over (partition by quality) - 1) / 2.0 as a, rank() over (order by detected) + (count(*) over (partition by detected) - 1) / 2.0 as b from q join d using (condition))
select count(*) as n, case when count(*) >= 3 and stddev_pop(a) > 0 and stddev_pop(b) > 0 then round(corr(a, b), 6) end as rho, case when count(*) < 3 or stddev_pop(a) = 0 or stddev_pop(b) = 0 then 'undefined' when abs(round(corr(a, b), 6)) >= 0.7 then case when corr(a, b) > 0 then 'strong positive' else 'strong negative' end when abs(round(corr(a, b), 6)) >= 0.4 then 'moderate' else 'weak' end as strength from r""")
def d05(spark, sf):
    """Rank correlation of a condition's quality with how easily it is detected."""
    e = table(spark, sf, "events").withColumnRenamed("event_type", "condition")
    q = e.where("condition <> 'view'").groupBy("condition").agg(F.avg("value").alias("quality"))
    d = e.groupBy("condition").agg((F.count_if(F.col("value") > 50) / F.count("*")).alias("detected"))
    both = joins.side_by_side(q, d, ["condition"]).where("quality is not null and detected is not null").withColumn("all", F.lit(1))
    out = ranking.spearman(both, ["all"], "quality", "detected")
    return out.select("n", F.round("rho", 6).alias("rho"), ranking.verdict(F.round("rho", 6)).alias("strength"))


@add("O11_sampling_weights_effective", "select quality, round(sum(w) * sum(w) / sum(w * w), 6) as effective from (select quality, (1 + doc_id % 3)::double as w from labels) group by 1")
def o11(spark, sf):
    rows = table(spark, sf, "labels").withColumn("w", (1 + F.col("doc_id") % 3).cast("double"))
    return sampling.effective_size(rows, ["quality"], "w").withColumn("effective", F.round("effective", 6))


QUERIES, ORACLE_SQL = catalogue.queries, catalogue.sql
