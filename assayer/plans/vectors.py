"""Array expressions, the verifier, decisions under policies and intervals by bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import scalar as X
from assayer.operators import classify, models, resample
from assayer.plans.registry import Catalogue, table

catalogue = Catalogue()
add = catalogue.add
#: Three logits, the sums of a vector's thirds, and its last component as a margin: every component is read.
_L = "[" + ", ".join(f"4 * list_sum(list_transform(embedding[{21 * k + 1}:{21 * k + 21}], lambda x: x::double))" for k in range(3)) + "]"
_LOGITS = f"(select vec_id, label, l, list_max(l) as top, embedding from (select vec_id, label, embedding, {_L} as l from embeddings))"


def _logits(spark, sf):
    third = lambda k: F.aggregate(F.slice("embedding", 21 * k + 1, 21), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf, "embeddings").withColumn("l", F.array(*(4 * third(k) for k in range(3))))


@add("Xs01_sigmoid", "select event_id, round(1 / (1 + exp(-(value - 50) / 20)), 9) as p from events where value is not null")
def xs01(spark, sf):
    return table(spark, sf, "events").where("value is not null").select("event_id", F.round(X.sigmoid((F.col("value") - 50) / 20), 9).alias("p"))


@add("Xs02_softmax", f"select vec_id, round(1 / list_sum(list_transform(l, lambda x: exp(x - top))), 9) as msp, list_position(l, top)::int - 1 as best from {_LOGITS}")
def xs02(spark, sf):
    rows = _logits(spark, sf)
    return rows.select("vec_id", F.round(X.max_softmax(F.col("l")), 9).alias("msp"), X.argmax(F.col("l")).alias("best"))


@add("Xs03_energy", f"select vec_id, round(-(top + 2 * ln(list_sum(list_transform(l, lambda x: exp((x - top) / 2))))), 6) as energy from {_LOGITS}")
def xs03(spark, sf):
    return _logits(spark, sf).select("vec_id", F.round(X.energy(F.col("l"), 2.0), 6).alias("energy"))


@add("Xs04_decibels", "select event_id, round(20 * log10(greatest(abs(value), 1e-12)), 6) as db from events where value is not null")
def xs04(spark, sf):
    return table(spark, sf, "events").where("value is not null").select("event_id", F.round(X.decibels(F.abs("value")), 6).alias("db"))


@add("Xs05_linear_decision", "select vec_id, round(list_sum(list_transform(embedding, lambda x, i: (x::double - i / 100.0::double) / (1 + i / 64.0::double) * (case when i % 2 = 0 then 1.5 else -1 end))) + 0.25, 6) as margin from embeddings")
def xs05(spark, sf):
    each = lambda f: F.array(*(F.lit(float(f(i))) for i in range(1, 65)))
    mean, scale, weight = each(lambda i: i / 100), each(lambda i: 1 + i / 64), each(lambda i: -1 if i % 2 else 1.5)
    margin = X.linear(F.col("embedding"), mean, scale, weight, F.lit(0.25))
    return table(spark, sf, "embeddings").select("vec_id", F.round(margin, 6).alias("margin"))


@add("Xs08_resampled_length", "select doc_id, ((n_chars * 22050 + 47999) // 48000)::bigint as n from documents")
def xs08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.resampled_length(F.col("n_chars")).alias("n"))


@add("Xs09_content_digest", "select doc_id, sha256(text) as digest from documents")
def xs09(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@add("Xs10_plain_text", "select doc_id, sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) as digest from documents")
def xs10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.plain_text(F.col("text")), 256).alias("digest"))


@add("Xs11_url_parts", "select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, len(string_split(url, '/')) as depth from pages")
def xs11(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.size(F.split("url", "/")).cast("long").alias("depth"))


@add("Xs13_repeat_to", "select vec_id, round(list_sum(list_transform(list_concat(e, e, e)[1:150], lambda x, i: x * i)), 6) as s from (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings)")
def xs13(spark, sf):
    padded = X.repeat_to(F.transform("embedding", lambda x: x.cast("double")), 150)
    weighed = F.transform(padded, lambda x, i: x * (i + 1))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@add("Xs15_json_fields", "select (props->>'k')::bigint as k, count(*) as n from events where props is not null group by 1")
def xs15(spark, sf):
    k = F.from_json("props", "k bigint").getField("k")
    return table(spark, sf, "events").where("props is not null").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@add("Xs17_close", "select l_returnflag, count(*) filter (where abs(l_quantity - 25) <= 0.5 + 0.1 * abs(25)) as n_close from lineitem group by 1")
def xs17(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(X.close(F.col("l_quantity"), F.lit(25.0), 0.5, 0.1)).alias("n_close"))


@add("Xs18_finite", "select count(*) filter (where value is not null and isfinite(value)) as n_finite, count(*) as n from events")
def xs18(spark, sf):
    return table(spark, sf, "events").agg(F.count_if(X.finite(F.col("value"))).alias("n_finite"), F.count("*").alias("n"))


_POLICIES = [("open", 0.5, -0.5), ("strict", 0.2, 1.5), ("reject", 0.5, None)]
_DECIDED = f"""(with p as (select * from (values ('open', 0.5::double, -0.5::double), ('strict', 0.2, 1.5), ('reject', 0.5, null)) t(policy, gate, cutoff)),
x as (select vec_id, label, embedding[64]::double as margin, top, l from {_LOGITS} where label <= 4)
select policy, vec_id, label, case when margin <= gate and cutoff is not null and top >= cutoff then list_position(l, top)::int - 1 else -1 end as label_out,
case when margin <= gate and cutoff is not null and top >= cutoff then 'attributed' when margin > gate then 'genuine' else 'uncertain' end as state,
case when margin <= gate and cutoff is not null and top >= cutoff then 'accepted' when cutoff is null then 'reject_all' when margin > gate then 'binary_gate' else 'support' end as reason from x, p)"""


def _decided(spark, sf):
    rows = _logits(spark, sf).where("label <= 4").select("vec_id", "label", F.element_at("embedding", 64).cast("double").alias("margin"), F.array_max("l").alias("top"), "l")
    policies = spark.createDataFrame(_POLICIES, "policy string, gate double, cutoff double")
    return classify.decide(rows, policies, "margin", "top", "l")


@add("F09_policy_decisions", f"select policy, vec_id, label_out, state from {_DECIDED}")
def f09(spark, sf):
    return _decided(spark, sf).select("policy", "vec_id", "label_out", "state")


@add("F10_decision_reasons", f"select policy, reason, count(*) as n from {_DECIDED} group by 1, 2")
def f10(spark, sf):
    return _decided(spark, sf).groupBy("policy", "reason").agg(F.count("*").alias("n"))


_OUTCOME = f"""(select *, case when label = 4 then case when label_out >= 0 then 'genuine_false_attribution' else 'genuine_no_attribution' end when label < 3 then case when label_out = label then 'known_correct' when label_out >= 0 then 'known_wrong' else 'known_rejected' end
else case when label_out >= 0 then 'withheld_wrong_attribution' when state = 'genuine' then 'withheld_rejected_real_like' else 'withheld_rejected_uncertain' end end as category from {_DECIDED})"""


def _outcomes(spark, sf):
    role = F.when(F.col("label") == 4, "genuine").when(F.col("label") < 3, "known").otherwise("withheld")
    return _decided(spark, sf).withColumn("category", classify.outcome(role, F.col("label"), F.col("label_out"), F.col("state")))


@add("F08_outcomes", f"select policy, category, count(*) as n from {_OUTCOME} group by 1, 2")
def f08(spark, sf):
    return _outcomes(spark, sf).groupBy("policy", "category").agg(F.count("*").alias("n"))


@add("A19_selective_scorecard", f"""select policy, known_correct, known_wrong, known_rejected, round((known_correct + known_wrong) / nullif(known_correct + known_wrong + known_rejected, 0)::double, 9) as coverage, round(known_correct / nullif(known_correct + known_wrong, 0)::double, 9) as selective_accuracy
from (select policy, count(*) filter (where category = 'known_correct') as known_correct, count(*) filter (where category = 'known_wrong') as known_wrong, count(*) filter (where category = 'known_rejected') as known_rejected from {_OUTCOME} group by rollup (policy))""")
def a19(spark, sf):
    out = classify.scorecard(_outcomes(spark, sf), "category", ["policy"])
    return out.select("policy", "known_correct", "known_wrong", "known_rejected", F.round("coverage", 9).alias("coverage"), F.round("selective_accuracy", 9).alias("selective_accuracy"))


@add("F15_prediction_projection", f"select vec_id, case when margin > 0.1 then 'real' else 'synthetic' end as verdict, case when margin > 0.1 then null else list_position(l, top)::int - 1 end as routed, round(l[1], 6) as logit_0, round(l[2], 6) as logit_1, round(l[3], 6) as logit_2 from (select vec_id, embedding[64]::double as margin, l, top from {_LOGITS})")
def f15(spark, sf):
    real = F.element_at("embedding", 64).cast("double") > 0.1
    return _logits(spark, sf).select("vec_id", F.when(real, "real").otherwise("synthetic").alias("verdict"), F.when(~real, X.argmax(F.col("l"))).alias("routed"), *(F.round(F.col("l")[i], 6).alias(f"logit_{i}") for i in range(3)))


@add("M03_verifier")
def m03(spark, sf):
    """Mahalanobis distance, largest softmax share and energy of every vector under a verifier fitted on labels 0-2."""
    rows = table(spark, sf, "embeddings")
    model = models.fit_verifier(rows.where("label < 3"), "embedding", "label")
    out = models.verify(models.centroid_logits(rows, model, "embedding"), model, "embedding", "logits")
    return out.select("vec_id", "label", *(F.round(c, 6).alias(c) for c in ("distance", "msp", "negative_energy")))


@add("M04_cutoff_and_gate", """with c as (select value, row_number() over (order by value) as k, count(*) over () as n from events where event_type = 'view' and value is not null),
g as (select value, row_number() over (order by value) as k, count(*) over () as n from events where event_type = 'click' and value is not null)
select (select value from c where k = floor(n * 0.05) + 1) as cutoff, (select max(n) from c)::bigint as n, round((select value from g where k = floor(n * 0.05) + 1), 9) as gate, true as below""")
def m04(spark, sf):
    """Calibration: what known rows must reach, and what genuine ones must stay below."""
    e = table(spark, sf, "events").where("value is not null")
    cutoff = models.confidence_cutoff(e.where("event_type = 'view'"), "value", 0.05)
    genuine = e.where("event_type = 'click'")
    gate = models.genuine_gate(genuine, "value", 0.05).select("gate")
    first = models.confidence_cutoff(genuine, "value", 0.05).select(F.col("cutoff").alias("first"))
    out = cutoff.crossJoin(gate).crossJoin(first)
    return out.select("cutoff", "n", F.round("gate", 9).alias("gate"), (F.col("gate") < F.col("first")).alias("below"))


def _balanced(spark, sf):
    return table(spark, sf, "embeddings").withColumn("y", (F.col("label") >= 5).cast("double"))


@add("M01_logistic_margins")
def m01(spark, sf):
    """Margins of a logistic regression, labels 0-4 against 5-9."""
    rows = _balanced(spark, sf)
    model = models.logistic(rows, "embedding", "y")
    return model.score(rows, "embedding").select("vec_id", "y", F.round("margin", 4).alias("margin"))


@add("M01_multinomial")
def m01_many(spark, sf):
    """The likeliest of all labels for every vector."""
    rows = table(spark, sf, "embeddings").where("label is not null")
    return models.logistic(rows, "embedding", "label").score(rows, "embedding").select("vec_id", "label", "predicted")


@add("M02_weighted_frozen")
def m02(spark, sf):
    """Row weights, under a normalisation that is frozen on other rows."""
    rows = _balanced(spark, sf).withColumn("w", 1.0 + F.col("vec_id") % 3)
    frozen = models.normalisation(rows.where("y = 0"), "embedding")
    return models.logistic(rows, "embedding", "y", weight="w", scaling=frozen).score(rows, "embedding").select("vec_id", F.round("margin", 4).alias("margin"))


@add("M06_out_of_fold")
def m06(spark, sf):
    """Every vector's probability under the model that has not seen its fold."""
    rows = _balanced(spark, sf).withColumn("fold", F.pmod("vec_id", F.lit(3)))
    return models.out_of_fold(rows, "embedding", "y", "fold", 3).select("vec_id", "fold", F.round("probability", 4).alias("probability"))


QUERIES, ORACLE_SQL = catalogue.queries, catalogue.sql
