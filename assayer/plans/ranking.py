"""Separability of event types and text lengths: tie-aware ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import ranking, sampling
from assayer.plans.registry import Catalogue, table

catalogue = Catalogue()
add = catalogue.add

_PAIRS = """with r as (select event_type as condition, value as score from events where event_type is not null and value is not null),
x as (select condition, score, false as is_ref from r where condition <> 'view'
  union all select c.condition, r.score, true from r, (select distinct condition from r where condition <> 'view') c where r.condition = 'view')"""
_LENGTHS = "with x as (select d.lang as condition, d.n_chars as score, l.{0} = 1 as is_ref from documents d join labels l using (doc_id))"
_EER = """, t as (select condition, score, count(*) filter (where is_ref) as p, count(*) filter (where not is_ref) as q from x group by 1, 2),
c as (select *, sum(p) over w as pc, sum(q) over w as qc, sum(p) over (partition by condition) as pa, sum(q) over (partition by condition) as qa from t window w as (partition by condition order by score)),
d as (select *, pc::double / pa as frr, (qa - qc)::double / qa as far, pc * qa = (qa - qc) * pa as exact, pc * qa >= (qa - qc) * pa as crossed from c where pa > 0 and qa > 0),
e as (select *, coalesce(lag(frr) over w, 0.0) as frr0, coalesce(lag(far) over w, 1.0) as far0 from d window w as (partition by condition order by score)),
f as (select *, row_number() over (partition by condition order by score) as k from e where crossed),
g as (select condition, pa::bigint as n_ref, qa::bigint as n_other, case when exact then frr else frr0 + (far0 - frr0) / ((far0 - frr0) - (far - frr)) * (frr - frr0) end as eer, score::double as threshold from f where k = 1) """


def _events(spark, sf):
    return ranking.against_reference(table(spark, sf, "events"), "event_type", "view", "value")


def _lengths(spark, sf, truth="quality"):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("condition"), F.col("n_chars").alias("score"), (F.col(truth) == 1).alias("is_ref"))


@add("A09_event_type_eer", _PAIRS + _EER + "select condition, n_ref, n_other, round(eer, 9) as eer, threshold from g")
def a09(spark, sf):
    """For each event type, how separable its values are from the reference type's."""
    out = ranking.eer(_events(spark, sf), ["condition"], "score", F.col("is_ref"), F.col("n"))
    return out.select("condition", "n_ref", "n_other", F.round("eer", 9).alias("eer"), "threshold")


@add("A08_quality_length_eer", _LENGTHS.format("quality").replace("d.lang", "'all'") + _EER + "select n_ref, n_other, round(eer, 9) as eer, threshold from g")
def a08(spark, sf):
    rows = _lengths(spark, sf).withColumn("condition", F.lit("all"))
    out = ranking.eer(rows, ["condition"], "score", F.col("is_ref"))
    return out.select("n_ref", "n_other", F.round("eer", 9).alias("eer"), "threshold")


@add("A10_both_directions_eer", f"""select a.condition, round(a.eer, 9) as forward, round(b.eer, 9) as reverse, round(least(a.eer, b.eer), 9) as least from
({_LENGTHS.format('quality')} {_EER} select * from g) a join ({_LENGTHS.format('quality').replace('d.n_chars', '-d.n_chars')} {_EER} select * from g) b using (condition)""")
def a10(spark, sf):
    rows = _lengths(spark, sf)
    one = ranking.eer(rows, ["condition"], "score", F.col("is_ref")).select("condition", F.col("eer").alias("forward"))
    two = ranking.eer(rows.withColumn("score", -F.col("score")), ["condition"], "score", F.col("is_ref")).select("condition", F.col("eer").alias("reverse"))
    return one.join(two, "condition").select("condition", F.round("forward", 9).alias("forward"), F.round("reverse", 9).alias("reverse"), F.round(F.least("forward", "reverse"), 9).alias("least"))


_AUC = """, ranked as (select *, rank() over (partition by condition order by score) + (count(*) over (partition by condition, score) - 1) / 2.0 as ar from x),
a as (select condition, count(*) filter (where is_ref) as n_pos, count(*) filter (where not is_ref) as n_neg, sum(ar) filter (where is_ref) as s from ranked group by 1)
select condition, n_pos, n_neg, round(case when n_pos > 0 and n_neg > 0 then (s - n_pos * (n_pos + 1) / 2.0) / (n_pos::double * n_neg) end, 9) as auroc from a"""


@add("A11_quality_length_auroc", _LENGTHS.format("quality") + _AUC)
def a11(spark, sf):
    out = ranking.auroc(_lengths(spark, sf), ["condition"], "score", F.col("is_ref"))
    return out.select("condition", "n_pos", "n_neg", F.round("auroc", 9).alias("auroc"))


@add("A07_event_type_auroc_unoriented", f"select condition, greatest(auroc, 1 - auroc) as separability from ({_PAIRS} {_AUC})")
def a07(spark, sf):
    out = ranking.auroc(_events(spark, sf), ["condition"], "score", F.col("is_ref"), F.col("n")).withColumn("auroc", F.round("auroc", 9))
    return out.select("condition", F.greatest("auroc", 1 - F.col("auroc")).alias("separability"))


@add("A12_weighted_roc", """with x as (select l_returnflag = 'R' as pos, l_quantity::bigint as w, l_discount as score from lineitem where l_quantity > 0),
t as (select score, coalesce(sum(w) filter (where pos), 0)::double as p, coalesce(sum(w) filter (where not pos), 0)::double as q from x group by 1),
c as (select *, sum(p) over (order by score) as pc, sum(q) over (order by score) as qc, sum(p) over () as pa, sum(q) over () as qa from t),
d as (select *, pc / pa as frr, 1 - qc / qa as far from c),
e as (select *, coalesce(lag(frr) over (order by score), 0.0) as frr0, coalesce(lag(far) over (order by score), 1.0) as far0 from d)
select 'R' as flag, round((select sum(p * (2 * qc - q)) / (2 * max(pa) * max(qa)) from c), 9) as auroc,
round((select frr0 + (far0 - frr0) / ((far0 - frr0) - (far - frr)) * (frr - frr0) from e where frr >= far order by score limit 1), 9) as eer""")
def a12(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.lit("R").alias("flag"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("pos"), F.col("l_quantity").cast("long").alias("w"))
    out = ranking.weighted_roc(rows, ["flag"], "score", F.col("pos"), "w")
    return out.select("flag", F.round("auroc", 9).alias("auroc"), F.round("eer", 9).alias("eer"))


@add("A13_common_mask_ranking", """with c as (select l_suppkey % 4 as part, l_discount as score, sum(case when l_returnflag = 'N' then 1 else 0 end) as n0, sum(case when l_returnflag = 'R' then 1 else 0 end) as n1 from lineitem group by 1, 2),
t as (select *, sum(n1) over w as pc, sum(n0) over w as qc, sum(n1) over (partition by part) as pa, sum(n0) over (partition by part) as qa from c window w as (partition by part order by score))
select part, round(sum(n1::double * (2 * qc - n0)) / (2.0 * max(pa) * max(qa)), 9) as auroc from t group by 1""")
def a13(spark, sf):
    """Each cell gives two weighted observations, one per class."""
    cell = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("part"), F.col("l_discount").alias("score")).agg(F.count_if(F.col("l_returnflag") == "N").alias("n0"), F.count_if(F.col("l_returnflag") == "R").alias("n1"))
    rows = cell.select("part", "score", F.expr("stack(2, false, n0, true, n1) as (pos, w)"))
    return ranking.weighted_roc(rows, ["part"], "score", F.col("pos"), "w").select("part", F.round("auroc", 9).alias("auroc"))


@add("A27_spearman_price_quantity", """with x as (select l_returnflag as flag, l_quantity as a, l_discount as b from lineitem where l_quantity is not null and l_discount is not null),
r as (select flag, rank() over (partition by flag order by a) + (count(*) over (partition by flag, a) - 1) / 2.0 as ra, rank() over (partition by flag order by b) + (count(*) over (partition by flag, b) - 1) / 2.0 as rb from x)
select flag, count(*) as n, round(corr(ra, rb), 6) as rho, case when abs(corr(ra, rb)) >= 0.4 then 'moderate' else 'weak' end as strength from r group by 1""")
def a27(spark, sf):
    out = ranking.spearman(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_discount"), ["flag"], "l_quantity", "l_discount")
    return out.select("flag", "n", F.round("rho", 6).alias("rho"), ranking.verdict(F.col("rho")).alias("strength"))


@add("T01_least_balanced_error", _LENGTHS.format("quality") + """, t as (select condition, score::double as score, count(*) filter (where is_ref) as p, count(*) filter (where not is_ref) as q from x group by 1, 2),
c as (select condition, score, sum(p) over w as pc, sum(q) over w as qc, sum(p) over (partition by condition) as pa, sum(q) over (partition by condition) as qa from t window w as (partition by condition order by score)),
u as (select condition, null::double as score, 0 as pc, 0 as qc, max(pa) as pa, max(qa) as qa from c group by 1 union all select * from c),
k as (select *, row_number() over (partition by condition order by pc * qa + (qa - qc) * pa, abs(pc * qa - (qa - qc) * pa), score nulls first) as k from u where pa > 0 and qa > 0)
select condition, score as threshold, round((pc * qa + (qa - qc) * pa) / (2.0 * pa * qa), 9) as balanced_error from k where k = 1""")
def t01(spark, sf):
    out = ranking.least_balanced_error(_lengths(spark, sf), ["condition"], "score", F.col("is_ref"))
    return out.select("condition", "threshold", F.round("balanced_error", 9).alias("balanced_error"))


_CUT = """with t as (select event_type as kind, value as score, count(*) as w from events where event_type in ('view', 'click') group by 1, 2),
c as (select *, sum(w) over (partition by kind order by score desc) as cum, sum(w) over (partition by kind) as total from t),
k as (select kind, max(score) filter (where cum > total * 0.05) as boundary, coalesce(max(cum) filter (where cum <= total * 0.05), 0) as flagged, max(total) as total from c group by 1)"""


@add("T02_control_cutoff", _CUT + " select kind, boundary, round(flagged::double / total, 9) as realised from k")
def t02(spark, sf):
    rows = table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).withColumnRenamed("event_type", "kind")
    return ranking.control_cutoff(rows, ["kind"], "value", F.lit(1), 0.05).select("kind", "boundary", F.round("realised", 9).alias("realised"))


@add("T03_common_operating_point", _CUT + """, m as (select max(boundary) as boundary from k)
select e.event_type as kind, m.boundary, count(*) filter (where e.value > m.boundary) as n_over, count(*) as n from events e, m where e.event_type in ('view', 'click') group by 1, 2""")
def t03(spark, sf):
    """The strictest of both kinds' cuts, and what each kind has above it."""
    rows = table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).withColumnRenamed("event_type", "kind")
    cut = ranking.control_cutoff(rows, ["kind"], "value", F.lit(1), 0.05).agg(F.max("boundary").alias("boundary"))
    return rows.crossJoin(F.broadcast(cut)).groupBy("kind", "boundary").agg(F.count_if(F.col("value") > F.col("boundary")).alias("n_over"), F.count("*").alias("n"))


@add("T04_quantile_cutoff", """select event_type as kind, n, cutoff from (select event_type, value as cutoff, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events where value is not null) where k = floor(n * 0.25) + 1""")
def t04(spark, sf):
    rows = table(spark, sf, "events").where("value is not null").withColumnRenamed("event_type", "kind")
    return sampling.order_statistic(rows, ["kind"], "value", 0.25)


@add("T07_recall_at_controls", """with t as (select value as score, count(*) filter (where event_type = 'purchase') as p, count(*) filter (where event_type = 'view') as a, count(*) filter (where event_type = 'click') as b from events group by 1),
c as (select sum(p) over w as p, sum(a) over w as a, sum(b) over w as b, sum(p) over () as pa, sum(a) over () as aa, sum(b) over () as ba from t window w as (order by score desc))
select max(pa)::bigint as n_pos, round(coalesce(max(p::double / pa) filter (where a <= 0.1 * aa and b <= 0.1 * ba), 0), 9) as recall from c""")
def t07(spark, sf):
    kind = F.col("event_type")
    out = ranking.recall_at_controls(table(spark, sf, "events"), "value", kind == "purchase", {"null": kind == "view", "swap": kind == "click"}, 0.1)
    return out.select("n_pos", F.round("recall", 9).alias("recall"))


@add("T05_grid_selection", """with x as (select d.n_chars as score, l.quality from documents d join labels l using (doc_id)), g as (select unnest([200, 400, 800, 1600, 3200]) as cut),
m as (select cut, count(*) filter (where score > cut and quality = 1) as tp, count(*) filter (where score > cut and quality = 0) as fp, count(*) filter (where score <= cut and quality = 1) as fn from g, x group by 1)
select cut, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 9) as f1 from m order by 2.0 * tp / (2 * tp + fp + fn) desc, fp, cut limit 1""")
def t05(spark, sf):
    """A small grid of cuts, the best by (-F1, false positives, cut)."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("n_chars", "quality")
    grid = spark.createDataFrame([(c,) for c in (200, 400, 800, 1600, 3200)], "cut int")
    over = F.col("n_chars") > F.col("cut")
    m = rows.crossJoin(F.broadcast(grid)).groupBy("cut").agg(F.count_if(over & (F.col("quality") == 1)).alias("tp"), F.count_if(over & (F.col("quality") == 0)).alias("fp"), F.count_if(~over & (F.col("quality") == 1)).alias("fn"))
    f1 = 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return m.withColumn("f1", f1).orderBy(F.desc("f1"), "fp", "cut").limit(1).withColumn("f1", F.round("f1", 9))


QUERIES, ORACLE_SQL = catalogue.queries, catalogue.sql
