"""Signal kernels as queries. The vectors of `embeddings` stand for channels: 64 samples at 64 Hz, or four of 16."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conditioning, joins, signals
from ..operators import timeseries as ts
from .catalogue import DAY, query, r6, table

RATE = 64.0
SAMPLES = "(SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
RESIDUALS = f"(SELECT s.vec_id, i, y - (a + b * i) AS r FROM {SAMPLES} s JOIN (SELECT vec_id, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM {SAMPLES} GROUP BY vec_id) f USING (vec_id))"
POWER = f"(SELECT vec_id, k, power(sum(r * cos(2 * pi() * k * i / 64)), 2) + power(sum(r * sin(2 * pi() * k * i / 64)), 2) AS p FROM {RESIDUALS} CROSS JOIN range(1, 33) t(k) GROUP BY ALL)"


def channels(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query(f"SELECT vec_id, arg_max(k, p) FILTER (k BETWEEN 2 AND 8)::DOUBLE AS peak, round(sum(p) FILTER (k BETWEEN 2 AND 8) / sum(p), 5) AS ratio FROM {POWER} GROUP BY vec_id")
def n02_band_summary(spark, d):
    rows = channels(spark, d).select("vec_id", signals.band("x", RATE, (2.0, 8.0), (1.0, 32.0)).alias("f"))
    return rows.select("vec_id", "f.peak", F.round("f.ratio", 5).alias("ratio"))


@query(f"""WITH m AS (SELECT vec_id, min(y) AS low, max(y) AS high FROM {SAMPLES} GROUP BY vec_id), s AS (SELECT *, y - lag(y) OVER (PARTITION BY vec_id ORDER BY i) AS step FROM {SAMPLES})
SELECT s.vec_id, 64 - count(y) AS missing, round(stddev_pop(y), 6) AS std, round(count(DISTINCT y) / count(y), 6) AS unique_share, round(avg((step = 0)::INT), 6) AS flat_share, round(avg((y = low OR y = high)::INT), 6) AS extrema_share FROM s JOIN m USING (vec_id) GROUP BY s.vec_id""")
def n03_channel_metrics(spark, d):
    rows = channels(spark, d).select("vec_id", signals.moments("x").alias("f"))
    return rows.select("vec_id", (F.lit(64) - F.col("f.n")).cast("long").alias("missing"), *(r6(f"f.{c}").alias(c) for c in ("std", "unique_share", "flat_share", "extrema_share")))


@query(f"SELECT vec_id, round(avg(y), 5) AS mean, round(stddev_pop(y), 5) AS std, round(quantile_cont(y, 0.5), 5) AS median, round(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 5) AS iqr, round(min(y), 5) AS minimum, round(max(y), 5) AS maximum, round(max(y) - min(y), 5) AS range, round(skewness(y), 4) AS skew, round(kurtosis(y), 4) AS kurtosis FROM {SAMPLES} GROUP BY vec_id")
def n04_channel_moments(spark, d):
    """The nine of the sixteen features that SQL can say."""
    rows = channels(spark, d).select("vec_id", signals.moments("x").alias("f"))
    own = {"mean": F.col("f.mean"), "std": F.col("f.std"), "median": F.col("f.median"), "iqr": F.col("f.q75") - F.col("f.q25"), "minimum": F.col("f.min"), "maximum": F.col("f.max"), "range": F.col("f.max") - F.col("f.min")}
    return rows.select("vec_id", *(F.round(c, 5).alias(k) for k, c in own.items()), F.round("f.skew", 4).alias("skew"), F.round("f.kurtosis", 4).alias("kurtosis"))


@query()
def n04_channel_features(spark, d):
    rows = channels(spark, d).select("vec_id", signals.channel_features("x", RATE).alias("f"))
    return rows.select("vec_id", "f.*")


@query()
def n05_peaks(spark, d):
    rows = channels(spark, d).select("vec_id", signals.pulse("x", RATE).alias("f"))
    return rows.select("vec_id", "f.*")


@query()
def n08_band_pass(spark, d):
    """Each channel without what lies outside 2 to 20 Hz, as z-scores."""
    return channels(spark, d).select("vec_id", signals.band_pass("x", RATE, 2.0, 20.0, scale="zscore").alias("filtered"))


QUALITY = f"""(WITH c AS (SELECT vec_id, avg((step = 0)::INT) AS flat FROM (SELECT *, y - lag(y) OVER (PARTITION BY vec_id ORDER BY i) AS step FROM {SAMPLES}) GROUP BY vec_id),
q AS (SELECT vec_id, ln(1 + quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) AS log_iqr, sqrt(avg(y * y) FILTER (i < 3)) AS motion, avg(y) AS mean FROM {SAMPLES} GROUP BY vec_id),
p AS (SELECT vec_id, k, power(sum((y - mean) * cos(2 * pi() * k * i / 64)), 2) + power(sum((y - mean) * sin(2 * pi() * k * i / 64)), 2) AS p FROM {SAMPLES} JOIN q USING (vec_id) CROSS JOIN range(0, 33) t(k) GROUP BY ALL),
b AS (SELECT vec_id, least(sum(p) FILTER (k BETWEEN 1 AND 8) / greatest(sum(p), 1e-12), 1) AS band FROM p GROUP BY vec_id)
SELECT vec_id, flat, log_iqr, band, motion, power(least(greatest(1 - flat / 0.05, 0), 1) * (log_iqr / (log_iqr + 1)) * band * exp(-motion), 0.25) AS sqi FROM c JOIN q USING (vec_id) JOIN b USING (vec_id))"""


def quality_of(spark, d):
    """Components and quality index of each channel; its first three samples stand for the axes of motion."""
    m = signals.moments("x")
    rows = channels(spark, d).select("vec_id", m["flat_share"].alias("flat"), F.log1p(m["q75"] - m["q25"]).alias("log_iqr"), F.least(signals.band("x", RATE, (0.5, 8.0), (0.5, 32.0), detrend=False)["ratio"], F.lit(1.0)).alias("band"), F.sqrt((F.get("x", 0) ** 2 + F.get("x", 1) ** 2 + F.get("x", 2) ** 2) / 3).alias("motion"))
    return rows.withColumn("sqi", signals.quality_index(F.col("flat"), F.col("log_iqr"), F.col("band"), F.col("motion")))


@query(f"SELECT vec_id, round(flat, 5) AS flat, round(log_iqr, 5) AS log_iqr, round(band, 5) AS band, round(motion, 5) AS motion, round(sqi, 5) AS sqi FROM {QUALITY}")
def n11_quality_index(spark, d):
    return quality_of(spark, d).select("vec_id", *(F.round(c, 5).alias(c) for c in ("flat", "log_iqr", "band", "motion", "sqi")))


@query()
def n12_conditioned_windows(spark, d):
    """Statistics of the conditioned channel beside flat share and amplitude of the raw one."""
    rows = channels(spark, d).withColumn("y", signals.band_pass("x", RATE, 2.0, 20.0, scale="zscore"))
    raw, own = signals.moments("x"), signals.moments("y")
    band = signals.band("y", RATE, (0.5, 8.0), (0.5, 32.0), detrend=False)["ratio"]
    return rows.select("vec_id", *(own[c].alias(c) for c in ("mean", "std", "min", "max", "q25", "q75")), raw["flat_share"].alias("flat_fraction"), F.log1p(raw["q75"] - raw["q25"]).alias("log_iqr"), F.least(band, F.lit(1.0)).alias("band_ratio"))


SPECS = [conditioning.Spec("raw"), conditioning.Spec("bp_2_20_zscore", (2.0, 20.0), "zscore"), conditioning.Spec("bp_4_16_robust", (4.0, 16.0), "robust")]


@query()
def n12_signal_windows(spark, d):
    """Windows of 16 samples of each user's events under three conditionings, up to the user's last purchase."""
    e = table(spark, d, "events")
    stops = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("stop_at"))
    windows = conditioning.signal_windows(e, "user_id", 16, 5 * DAY, stops=stops)
    return conditioning.conditioned(windows, "user_id", RATE, SPECS, (2.0, 8.0))


@query("SELECT l_suppkey, count(*) AS n, round(sqrt(avg(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax)), 6) AS rms FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL GROUP BY l_suppkey")
def n13_triaxial_rms(spark, d):
    """Root mean square of a magnitude over three axes; rows without one of them go."""
    axes = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]
    rows = table(spark, d, "lineitem").select("l_suppkey", *axes).dropna()
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(axes[0] * axes[0] + axes[1] * axes[1] + axes[2] * axes[2]))).alias("rms"))


@query(f"""SELECT p.event_id, round(quantile_cont(w.value, 0.25), 6) AS p25, round(avg(w.value), 6) AS mean, round(min(w.value), 6) AS low, round(quantile_cont(w.hour, 0.25), 6) AS motion_p25 FROM events p
JOIN (SELECT *, hour(ts)::DOUBLE AS hour FROM events) w ON w.user_id = p.user_id AND epoch_us(w.ts) BETWEEN epoch_us(p.ts) - {3 * DAY} AND epoch_us(p.ts) GROUP BY p.event_id HAVING count(*) >= 3""")
def n14_quality_history(spark, d):
    """Quantiles of what lies in each endpoint's history; too short ones go."""
    e = table(spark, d, "events").withColumn("t", ts.micros("ts")).withColumn("hour", F.hour("ts").cast("double"))
    points = e.select("event_id", "user_id", (F.col("t") - 3 * DAY).alias("a"), F.col("t").alias("b"))
    found = joins.history_join(points, e.select("user_id", "value", "hour", "t"), "user_id", "a", "b", "t", 3 * DAY)
    out = found.groupBy("event_id").agg(F.count("*").alias("n"), r6(F.percentile("value", 0.25)).alias("p25"), r6(F.avg("value")).alias("mean"), r6(F.min("value")).alias("low"), r6(F.percentile("hour", 0.25)).alias("motion_p25"))
    return out.where("n >= 3").drop("n")


QUARTERS = "(SELECT vec_id, i // 16 AS c, i % 16 AS j, y FROM " + SAMPLES + ")"
FLAGS = f"""(WITH m AS (SELECT vec_id, c, min(y) AS low, max(y) AS high FROM {QUARTERS} GROUP BY ALL), s AS (SELECT *, y - lag(y) OVER (PARTITION BY vec_id, c ORDER BY j) AS step FROM {QUARTERS}),
k AS (SELECT s.vec_id, s.c, avg((step = 0)::INT) AS flat, avg((y = low OR y = high)::INT) AS extrema, list(y ORDER BY j) AS v FROM s JOIN m USING (vec_id, c) GROUP BY ALL),
w AS (SELECT q.vec_id, q.c, f, power(sum((y - a) * cos(2 * pi() * f * j / 16)), 2) + power(sum((y - a) * sin(2 * pi() * f * j / 16)), 2) AS p FROM {QUARTERS} q JOIN (SELECT vec_id, c, avg(y) AS a FROM {QUARTERS} GROUP BY ALL) b USING (vec_id, c) CROSS JOIN range(1, 9) t(f) GROUP BY ALL),
b AS (SELECT vec_id, c, sum(p) FILTER (f BETWEEN 1 AND 3) / sum(p) AS ratio FROM w GROUP BY ALL),
r AS (SELECT vec_id, unnest(list_filter([CASE WHEN flat > 0.05 THEN 'FLAT_SCREEN_' || c END, CASE WHEN extrema > 0.2 THEN 'EXTREMA_SCREEN_' || c END, CASE WHEN ratio < 0.25 THEN 'PULSE_SCREEN_' || c END], lambda x: x IS NOT NULL)) AS code FROM k JOIN b USING (vec_id, c)
  UNION ALL SELECT vec_id, 'DUPLICATE_CONTENT' FROM k GROUP BY vec_id HAVING count(DISTINCT v) < 4 UNION ALL SELECT e.vec_id, 'MISSING_REFERENCE' FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id WHERE l.quality IS NULL
  UNION ALL SELECT vec_id, 'RATE_MISMATCH' FROM embeddings WHERE abs(len(embedding) / CASE WHEN vec_id % 7 = 0 THEN 2.0 ELSE 1.0 END - 64) > 0.01)
SELECT e.vec_id, coalesce(string_agg(DISTINCT code, ';' ORDER BY code), '') AS reasons FROM embeddings e LEFT JOIN r USING (vec_id) GROUP BY e.vec_id)"""


def flags_of(spark, d):
    """vec_id, reasons: sorted codes of what is wrong with a recording of four channels and its reference."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.join(table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id", "left")
    seconds = F.when(F.col("vec_id") % 7 == 0, 2.0).otherwise(1.0)
    codes = [F.when(F.col("quality").isNull(), "MISSING_REFERENCE"), F.when(F.abs(F.size("x") / seconds - 64) > 0.01, "RATE_MISMATCH")]
    parts = [F.slice("x", 16 * c + 1, 16) for c in range(4)]
    rows = rows.withColumns({f"c{c}": p for c, p in enumerate(parts)})
    codes.append(F.when(F.size(F.array_distinct(F.array(*(f"c{c}" for c in range(4))))) < 4, "DUPLICATE_CONTENT"))
    for c in range(4):
        m, ratio = signals.moments(f"c{c}"), signals.band(f"c{c}", 16.0, (1.0, 3.0), (1.0, 8.0), detrend=False)["ratio"]
        codes += [F.when(m["n"] < 16, f"NONFINITE_{c}"), F.when(m["flat_share"] > 0.05, f"FLAT_SCREEN_{c}"), F.when(m["extrema_share"] > 0.2, f"EXTREMA_SCREEN_{c}"), F.when(F.coalesce(ratio, F.lit(0.0)) < 0.25, f"PULSE_SCREEN_{c}")]
    return rows.select("vec_id", F.array_sort(F.array_compact(F.array(*codes))).alias("codes"))


@query(f"SELECT vec_id, reasons, reasons = '' AS usable, NOT contains(reasons, 'MISSING_REFERENCE') AS eligible, replace(replace(reasons, 'MISSING_REFERENCE', ''), ';', '') = '' AS screen_pass FROM {FLAGS}")
def n15_audit_flags(spark, d):
    rows, missing = flags_of(spark, d), F.array_contains("codes", "MISSING_REFERENCE")
    signal = F.size(F.array_remove("codes", "MISSING_REFERENCE")) == 0
    return rows.select("vec_id", F.array_join("codes", ";").alias("reasons"), (F.size("codes") == 0).alias("usable"), (~missing).alias("eligible"), signal.alias("screen_pass"))


@query(f"""SELECT code, count(*) AS n, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS share FROM (SELECT vec_id, unnest(CASE WHEN reasons = '' THEN ['NONE'] ELSE string_split(reasons, ';') END) AS code FROM {FLAGS}) GROUP BY code""")
def n16_audit_summary(spark, d):
    """How many recordings each reason excludes, and their share of all."""
    rows = flags_of(spark, d).select(F.explode(F.when(F.size("codes") == 0, F.array(F.lit("NONE"))).otherwise(F.col("codes"))).alias("code"))
    total = table(spark, d, "embeddings").count()
    return rows.groupBy("code").agg(F.count("*").alias("n")).select("code", "n", r6(F.col("n") / F.lit(total)).alias("share"))
