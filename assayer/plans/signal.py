"""Signal kernels over array columns (the embedding stands in for a short signal); held against numpy in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from assayer.functions import signal as G
from assayer.plans.registry import Catalogue, table

catalogue = Catalogue()
add = catalogue.add
RATE = 16_000


def _x(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def _out(df, digits=6):
    return df.select("vec_id", F.transform("v", lambda x: F.round(x, digits)).alias("v"))


@add("X01_window_features")
def x01(spark, sf):
    return _out(G.apply(_x(spark, sf), "embedding", ["vec_id"], lambda x: G.window_features(x[None], RATE)[0], "v"))


@add("X02_clip_statistics")
def x02(spark, sf):
    return _out(G.apply(_x(spark, sf), "embedding", ["vec_id"], lambda x: G.clip_statistics(x, RATE), "v"))


@add("X03_log_mel")
def x03(spark, sf):
    """Mean and deviation over frames of 24 log-mel bands."""

    def both(x):
        m = G.log_mel(x, RATE)
        return np.concatenate([m.mean(0), m.std(0)])

    return _out(G.apply(_x(spark, sf), "embedding", ["vec_id"], both, "v"))


#: Spectra in SQL: re and im of each of the 33 frequencies of a vector of 64.
_SPECTRUM = """(select vec_id, k, sum(x * {w} * cos(2 * pi() * i * k / 64)) as re, -sum(x * {w} * sin(2 * pi() * i * k / 64)) as im
from (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings) e, (select unnest(range(33)) as k) group by 1, 2)"""


@add("X04_low_pass", f"""with s as {_SPECTRUM.format(w="1")}, d as (select ceil(acosh(sqrt((power(10, 6) - 1) / (power(10, 0.025) - 1))) / acosh(tan(pi() * 4000 / 16000) / tan(pi() * 3800 / 16000)) - 1e-9) as n),
g as (select k, case when k = 0 then 1.0::double else t * t / (power(10, 6) - 1) / (1 + t * t / (power(10, 6) - 1)) end as g from (select k, case when v <= 1 then cos(n * acos(v)) else cosh(n * acosh(greatest(v, 1))) end as t
  from (select k, n, case when k = 32 then 0 else tan(pi() * 0.25) / tan(pi() * greatest(k, 1) / 64) end as v from (select unnest(range(33)) as k), d)))
select vec_id, i::int as i, round(sum((case when k in (0, 32) then 1 else 2 end) * g * (re * cos(2 * pi() * i * k / 64) - im * sin(2 * pi() * i * k / 64))) / 64, 6) as v from s join g using (k), (select unnest(range(64)) as i) group by 1, 2""")
def x04(spark, sf):
    """Each vector under a zero-phase band limit, one row for each place."""
    out = G.apply(_x(spark, sf), "embedding", ["vec_id"], lambda x: G.low_pass(x, RATE, 4000.0), "v")
    return out.select("vec_id", F.posexplode("v").alias("i", "v")).withColumn("v", F.round("v", 6))


@add("X05_high_fraction", f"""select vec_id, round(sum(p) filter (where k > 16) / sum(p), 6) as v from (select vec_id, k, re * re + im * im as p from {_SPECTRUM.format(w="(0.42 - 0.5 * cos(2 * pi() * i / 63) + 0.08 * cos(4 * pi() * i / 63))")}) group by 1""")
def x05(spark, sf):
    out = G.apply(_x(spark, sf), "embedding", ["vec_id"], lambda x: G.high_fraction(x, RATE, 4000.0), "v")
    return out.select("vec_id", F.round(F.col("v")[0], 6).alias("v"))


@add("X06_spectral_distance")
def x06(spark, sf):
    """Distance of each vector to its band-limited self."""
    return _out(G.apply(_x(spark, sf), "embedding", ["vec_id"], lambda x: G.spectral_distance(G.low_pass(x, RATE, 4000.0), x, RATE, (2000.0, 4000.0), 32, 16), "v"), 4)


@add("X07_lag")
def x07(spark, sf):
    return _out(G.apply(_x(spark, sf), "embedding", ["vec_id"], lambda x: G.lag(np.roll(x, 3), x, 16), "v"))


@add("X08_periodicity")
def x08(spark, sf):
    return _out(G.apply(_x(spark, sf), "embedding", ["vec_id"], lambda x: G.periodicity(x, RATE, 300.0, 4000.0), "v"))


@add("X10_splice", """select vec_id, (i - 1)::int as i, floor((case when i <= 20 or i > 40 or x = y then x else (1 - w) * x + w * y end) * 32768) / 32768 as v
from (select vec_id, i, embedding[i]::double as x, embedding[i + 20]::double as y, least(1.0::double, (i - 20) / 4.0::double, (41 - i) / 4.0::double) as w from embeddings, (select unnest(range(1, 65)) as i))""")
def x10(spark, sf):
    """A later excerpt of each vector in place of an earlier one, with crossfades, on the 16-bit grid."""
    out = G.apply(_x(spark, sf), "embedding", ["vec_id"], lambda x: G.splice(x, x[40:60], 20, 3), "v")
    return out.select("vec_id", F.posexplode("v").alias("i", "v"))


@add("X12_core_measures", """with f as (select vec_id, j, sqrt(avg(x * x)) as level from (select vec_id, j, unnest(embedding[j * 16 + 1 : j * 16 + 32])::double as x from embeddings, (select unnest(range(3)) as j)) group by 1, 2),
m as (select vec_id, sqrt(avg(x * x)) as rms, max(abs(x)) as peak from (select vec_id, unnest(embedding)::double as x from embeddings) group by 1)
select vec_id, round(rms, 6) as rms, round(peak, 6) as peak, round(avg(case when level >= 0.125 then 1.0 else 0.0 end), 6) as active from m join f using (vec_id) group by vec_id, rms, peak""")
def x12(spark, sf):
    """Level, peak and share of active frames of each vector; the features over active frames are in the operator's other columns."""
    out = G.apply(_x(spark, sf), "embedding", ["vec_id"], lambda x: G.core_measures(x, RATE, 0.125, 32, 16), "v")
    return out.select("vec_id", *(F.round(F.col("v")[k], 6).alias(n) for k, n in enumerate(("rms", "peak", "active"))))


@add("X13_stress_levels", """select vec_id, cell, round(sqrt(avg(x * x)) * g, 6) as level from (select vec_id, unnest(embedding)::double as x from embeddings), (values ('clean', 1.0::double), ('gain_minus6', power(10, -0.3)), ('gain_minus12', power(10, -0.6)), ('first2', 1.0)) c(cell, g) group by 1, 2, g""")
def x13(spark, sf):
    """The level of each vector under stress conditions that keep its spectrum."""
    cells = ("clean", "gain_minus6", "gain_minus12", "first2")
    out = G.apply(_x(spark, sf), "embedding", ["vec_id"], lambda x: [np.sqrt((G.stressed(x, RATE, c) ** 2).mean()) for c in cells], "v")
    name = F.element_at(F.array(*map(F.lit, cells)), F.col("k") + 1)
    return out.select("vec_id", F.posexplode("v").alias("k", "level")).select("vec_id", name.alias("cell"), F.round("level", 6).alias("level"))


@add("X16_quantised", "select vec_id, (i - 1)::int as i, floor(least(greatest(embedding[i]::double, -1), 1 - 1 / 32768.0::double) * 32768) / 32768 as v from embeddings, (select unnest(range(1, 65)) as i)")
def x16(spark, sf):
    out = G.apply(_x(spark, sf), "embedding", ["vec_id"], G.quantised, "v")
    return out.select("vec_id", F.posexplode("v").alias("i", "v"))


QUERIES, ORACLE_SQL = catalogue.queries, catalogue.sql
