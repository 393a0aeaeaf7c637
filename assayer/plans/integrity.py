"""Integrity constraints over orders, events and documents: the rows that break them."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.scalar import plain_text
from assayer.operators import constraints as C
from assayer.operators import dedup, joins
from assayer.plans.registry import Catalogue, table

catalogue = Catalogue()
add = catalogue.add
#: The split that a unit belongs to, by the last hexadecimal digits of its digest.
SPLIT_SQL = "case when substr(sha256('split:' || {0}), 1, 1) < 'b' then 'train' when substr(sha256('split:' || {0}), 1, 1) < 'd' then 'dev' else 'eval' end"


def split_of(unit):
    first = F.substring(F.sha2(F.concat(F.lit("split:"), unit.cast("string")), 256), 1, 1)
    return F.when(first < "b", "train").when(first < "d", "dev").otherwise("eval")


@add("C02_outside_domain", "select l_returnflag as value, count(*) as n from lineitem where l_returnflag is null or l_returnflag not in ('A', 'N') group by 1")
def c02(spark, sf):
    return C.outside_domain(table(spark, sf, "lineitem"), "l_returnflag", ["A", "N"])


@add("C03_one_customer_per_order", "select l_orderkey, count(distinct l_returnflag) as n_l_returnflag from lineitem where l_orderkey is not null group by 1 having count(distinct l_returnflag) > 1")
def c03(spark, sf):
    """A dependency that test data do break: one return flag per order."""
    return C.broken_dependency(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag")


@add("C04_dependency_over_columns", "select o_custkey, count(distinct o_orderstatus) as n_o_orderstatus, count(distinct o_orderpriority) as n_o_orderpriority from orders where o_custkey is not null group by 1 having count(distinct o_orderstatus) > 1 or count(distinct o_orderpriority) > 1")
def c04(spark, sf):
    return C.broken_dependency(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", "o_orderpriority")


@add("C05_unpaired_conditions", """with r as (select distinct event_type as condition, user_id as unit from events), f as (select unit from r where condition = 'view'), c as (select distinct condition from r where condition <> 'view'),
m as (select c.condition, f.unit, 'missing' as side from c, f where not exists (select 1 from r where r.condition = c.condition and r.unit = f.unit) union all select condition, unit, 'extra' from r where condition <> 'view' and unit not in (select unit from f)),
k as (select *, row_number() over (partition by condition, side order by unit) as k from m)
select condition, side, count(*) as n, string_agg(unit::varchar, ',' order by unit) filter (where k <= 5) as some from k group by 1, 2""")
def c05(spark, sf):
    return C.unpaired(table(spark, sf, "events"), "event_type", "user_id", "view")


@add("C06_not_constant", "select o_orderpriority, count(*) filter (where o_orderstatus is null) as n_null, count(*) filter (where o_orderstatus <> 'F') as n_other from orders group by 1 having count(*) filter (where o_orderstatus is null) + count(*) filter (where o_orderstatus <> 'F') > 0")
def c06(spark, sf):
    return C.not_constant(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", "F")


@add("C07_inconsistent_totals", "select o_orderkey, round(o_totalprice, 2) as stated, round(s, 2) as summed from orders join (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as s from lineitem group by 1) on l_orderkey = o_orderkey where abs(o_totalprice - s) > 0.5")
def c07(spark, sf):
    price = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("s"))
    both = table(spark, sf, "orders").join(price, F.col("o_orderkey") == F.col("l_orderkey")).where(F.abs(F.col("o_totalprice") - F.col("s")) > 0.5)
    return both.select("o_orderkey", F.round("o_totalprice", 2).alias("stated"), F.round("s", 2).alias("summed"))


@add("C08_all_checked", "select l_linestatus, bool_and(l_quantity > 0) as checked, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags from lineitem group by 1")
def c08(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.bool_and(F.col("l_quantity") > 0).alias("checked"), F.concat_ws(",", F.array_sort(F.collect_set("l_returnflag"))).alias("flags"))


@add("C09_incomplete_groups", """with h as (select l_orderkey, list_sort(list(distinct l_returnflag)) as have from lineitem group by 1)
select l_orderkey, array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda x: not list_contains(have, x))), ',') as missing, '' as extra from h where len(have) < 3""")
def c09(spark, sf):
    return C.incomplete(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "N", "R"])


@add("C10_leaked_content", f"select sha256(text) as content, count(distinct {SPLIT_SQL.format('doc_id::varchar')}) as n_splits, count(*) as n from documents where text is not null group by 1 having count(distinct {SPLIT_SQL.format('doc_id::varchar')}) > 1")
def c10(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").withColumn("split", split_of(F.col("doc_id")))
    return C.leaked(docs, F.sha2("text", 256), "split")


@add("C11_five_classes", "select user_id, array_to_string(list_sort(list_filter(['cart', 'click', 'purchase', 'signup', 'view'], lambda x: not list_contains(have, x))), ',') as missing, array_to_string(list_sort(list_filter(have, lambda x: x not in ('cart', 'click', 'purchase', 'signup', 'view'))), ',') as extra from (select user_id, list(distinct event_type) as have from events group by 1) where len(list_filter(['cart', 'click', 'purchase', 'signup', 'view'], lambda x: not list_contains(have, x))) > 0 or len(list_filter(have, lambda x: x not in ('cart', 'click', 'purchase', 'signup', 'view'))) > 0")
def c11(spark, sf):
    return C.incomplete(table(spark, sf, "events"), ["user_id"], "event_type", ["cart", "click", "purchase", "signup", "view"])


@add("C13_row_predicates", "select l_orderkey, l_linenumber, case when l_discount > 0.09 then 'discount' else 'quantity' end as rule from lineitem where l_discount > 0.09 or l_quantity < 2")
def c13(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_discount > 0.09 or l_quantity < 2")
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.09, "discount").otherwise("quantity").alias("rule"))


@add("C14_bad_cover", """with t as (select conv_id, turn as s, turn + 1 as e, case when role = 'user' then 1 else 0 end as label from conversations), o as (select *, lag(e) over (partition by conv_id order by s, e) as b from t)
select conv_id, count(*) filter (where b is not null and b <> s) as n_bad, min(s) as first, max(e) as last, 4::bigint as size from o group by 1 having count(*) filter (where b is not null and b <> s) > 0 or min(s) <> 0 or max(e) <> 4""")
def c14(spark, sf):
    """Conversations whose turns aren't a gapless cover of [0, 4)."""
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("s"), (F.col("turn") + 1).alias("e"), F.lit(4).cast("long").alias("size"), F.when(F.col("role") == "user", 1).otherwise(0).alias("label"))
    return C.bad_cover(rows, ["conv_id"], "s", "e", "size", "label", [0, 1, -1])


@add("C15_overlapping_parts", f"select user_id from events where {SPLIT_SQL.format('user_id::varchar')} = 'train' intersect select user_id from events where event_type = 'purchase'")
def c15(spark, sf):
    e = table(spark, sf, "events").withColumn("split", split_of(F.col("user_id")))
    return C.overlap(e.where("split = 'train'"), e.where("event_type = 'purchase'"), "user_id")


@add("C16_evidence_recomputed", """with m as (select event_type, avg(value) as mean, median(value) as median, min(value) as low, max(value) as high from events group by 1)
select event_type, round(mean, 6) as mean, round(median, 6) as median, low, high, abs(mean - median) <= 0.05 * abs(median) as close from m""")
def c16(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))
    return m.select("event_type", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "low", "high", (F.abs(F.col("mean") - F.col("median")) <= 0.05 * F.abs("median")).alias("close"))


@add("C17_bracket", "select event_type, max(value) filter (where user_id % 7 = 0) as null_high, min(value) filter (where user_id % 7 <> 0) as hit_low, coalesce(max(value) filter (where user_id % 7 = 0) < min(value) filter (where user_id % 7 <> 0), false) as separated from events group by 1")
def c17(spark, sf):
    null = F.col("user_id") % 7 == 0
    out = table(spark, sf, "events").groupBy("event_type").agg(F.max(F.when(null, F.col("value"))).alias("null_high"), F.min(F.when(~null, F.col("value"))).alias("hit_low"))
    return out.withColumn("separated", F.coalesce(F.col("null_high") < F.col("hit_low"), F.lit(False)))


_A, _B = "(select url, page_id, sha256(html) as v from pages where page_id % 5 <> 0)", "(select url, page_id, sha256(case when page_id % 4 = 0 then html || 'x' else html end) as v from pages where page_id % 7 <> 0)"


@add("C18_differing_inventories", f"""select page_id, case when b.v is null then 'left' when a.v is null then 'right' else 'both' end as side, a.v as left_value, b.v as right_value
from {_A} a full outer join {_B} b using (page_id) where a.v is null or b.v is null or a.v <> b.v""")
def c18(spark, sf):
    p = table(spark, sf, "pages")
    a = p.where("page_id % 5 <> 0").select("page_id", F.sha2("html", 256).alias("v"))
    b = p.where("page_id % 7 <> 0").select("page_id", F.sha2(F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("v"))
    return C.differing(a, b, ["page_id"], "v")


@add("C19_citable_runs", "select o_orderpriority, bool_and(coalesce(o_totalprice > 1000, false)) as citable, count(*) as n from orders group by 1")
def c19(spark, sf):
    return C.citable(table(spark, sf, "orders").withColumn("ok", F.col("o_totalprice") > 1000), ["o_orderpriority"], "ok")


@add("C21_replayed_totals", """with a as (select l_returnflag as flag, sum(l_quantity) as q, count(*)::double as n from lineitem group by 1), b as (select flag, sum(q) as q, sum(n)::double as n from (select l_returnflag as flag, l_linestatus, sum(l_quantity) as q, count(*) as n from lineitem group by 1, 2) group by 1)
select flag, 'q' as "column", a.q as "left", b.q as "right" from a join b using (flag) where abs(a.q - b.q) > 1e-9""")
def c21(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    one = rows.groupBy("flag").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    two = rows.groupBy("flag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n")).groupBy("flag").agg(F.sum("q").alias("q"), F.sum("n").alias("n"))
    return C.beyond_tolerance(one, two, ["flag"], ["q", "n"], 1e-9, 0.0)


@add("C22_explicit_flags", "select count(*) filter (where toxic = 1) as n_true, count(*) filter (where toxic = 0) as n_false, count(*) filter (where toxic is null) as n_unknown from labels")
def c22(spark, sf):
    flag = F.col("toxic") == 1
    return table(spark, sf, "labels").agg(F.count_if(flag.eqNullSafe(True)).alias("n_true"), F.count_if(flag.eqNullSafe(False)).alias("n_false"), F.count_if(flag.isNull()).alias("n_unknown"))


@add("C23_units_without_peaks", "select event_type, count(*) as n from events where user_id not in (select user_id from events where value > 400 and user_id is not null) group by 1")
def c23(spark, sf):
    return C.excluded_units(table(spark, sf, "events"), "user_id", F.col("value") > 400).groupBy("event_type").agg(F.count("*").alias("n"))


@add("C01_all_violations", """select 'order_dependency' as rule, l_orderkey::varchar as key, count(distinct l_returnflag)::varchar as detail from lineitem where l_orderkey is not null group by l_orderkey having count(distinct l_returnflag) > 1
union all select 'domain', l_returnflag, count(*)::varchar from lineitem where l_returnflag is null or l_returnflag not in ('A', 'N') group by l_returnflag
union all select 'repeated_key', o_orderkey::varchar, count(*)::varchar from orders group by o_orderkey having count(*) > 1
union all select 'negative_value', event_id::varchar, value::varchar from events where value < 0""")
def c01(spark, sf):
    """All rules in one table of violations."""
    items, orders, events = (table(spark, sf, t) for t in ("lineitem", "orders", "events"))
    return C.all_of(
        C.rule(C.broken_dependency(items, ["l_orderkey"], "l_returnflag"), "order_dependency", F.col("l_orderkey"), F.col("n_l_returnflag")),
        C.rule(C.outside_domain(items, "l_returnflag", ["A", "N"]), "domain", F.col("value"), F.col("n")),
        C.rule(C.repeated(orders, ["o_orderkey"]), "repeated_key", F.col("o_orderkey"), F.col("n")),
        C.rule(events.where("value < 0"), "negative_value", F.col("event_id"), F.col("value")),
    )


@add("U06_colliding_content", """with d as (select doc_id, sha256(text) as exact, sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) as plain, sha256(regexp_replace(lower(text), '[^a-z]', '', 'g')) as letters from documents),
f as (select doc_id, 'exact' as kind, exact as value from d union all select doc_id, 'plain', plain from d union all select doc_id, 'letters', letters from d),
s as (select kind, value from f where value is not null group by 1, 2 having count(*) > 1)
select doc_id, count(distinct kind) as n_keys, string_agg(distinct kind, ',' order by kind) as kinds from f semi join s using (kind, value) group by 1""")
def u06(spark, sf):
    """Documents that share a digest of their text, of it in plain form, or of its letters alone."""
    letters = F.sha2(F.regexp_replace(F.lower("text"), "[^a-z]", ""), 256)
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("exact"), F.sha2(plain_text(F.col("text")), 256).alias("plain"), letters.alias("letters"))
    return dedup.collisions(docs, "doc_id", ["exact", "plain", "letters"])


@add("U04_symmetric_difference", "(select l_returnflag as v, 'left' as side from (select l_returnflag from lineitem where l_quantity > 49 except all select l_returnflag from lineitem where l_discount > 0.09)) union all (select l_returnflag, 'right' from (select l_returnflag from lineitem where l_discount > 0.09 except all select l_returnflag from lineitem where l_quantity > 49))")
def u04(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "v")
    return dedup.symmetric_difference(rows.where("l_quantity > 49").select("v"), rows.where("l_discount > 0.09").select("v"))


@add("U01_stacked_runs", "select event_type, count(*) as n from (select event_type from events where user_id % 2 = 0 union all select event_type from events where user_id % 2 = 1 and event_type <> 'view') group by 1")
def u01(spark, sf):
    e = table(spark, sf, "events")
    return dedup.stacked([e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")], "event_type", "view").groupBy("event_type").agg(F.count("*").alias("n"))


@add("U02_concatenated", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def u02(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    parts = [rows.where(F.col("l_returnflag") == f) for f in "ANR"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@add("U03_distinct_keys", "select distinct l_partkey, l_suppkey from lineitem")
def u03(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


@add("U05_common_keys", "select l_orderkey from lineitem where l_returnflag = 'R' intersect select l_orderkey from lineitem where l_returnflag = 'N'")
def u05(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.where("l_returnflag = 'R'").select("l_orderkey").intersect(rows.where("l_returnflag = 'N'").select("l_orderkey"))


@add("J05_same_bytes", f"select count(*) filter (where a.v is not null and b.v is not null) as n_both, count(*) filter (where a.v is null or b.v is null) as n_one_side, count(*) filter (where a.v <> b.v) as n_differing from {_A} a full outer join {_B} b using (page_id)")
def j05(spark, sf):
    p = table(spark, sf, "pages")
    a = p.where("page_id % 5 <> 0").select("page_id", F.sha2("html", 256).alias("v"))
    b = p.where("page_id % 7 <> 0").select("page_id", F.sha2(F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("v"))
    return joins.same_bytes(a, b, ["page_id"], "v")


QUERIES, ORACLE_SQL = catalogue.queries, catalogue.sql
