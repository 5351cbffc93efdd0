"""All reference queries by name, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import checks, distribution, evaluation, joins, sequences, signals, slopes, splits
from ..operators import timeseries as ts

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
HOUR, DAY = 3_600_000_000, 86_400_000_000


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL; without SQL, a test holds it to another implementation."""

    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


LAG = "SELECT *, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events"
ISLANDS = f"SELECT *, sum(CASE WHEN gap > {12 * HOUR} OR gap <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM ({LAG})"
SPANS = f"SELECT user_id, min(t) AS span_start, max(t) AS span_end, count(*) AS n_rows FROM ({ISLANDS}) GROUP BY user_id, island"
SLOPE = f"""SELECT *, epoch_us(ts) AS t, regr_slope(value, (epoch_us(ts) - 1704067200000000) / 86400000000.0) OVER w AS slope, count(value) OVER w AS support
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW)"""
LABEL = "CASE WHEN slope < -20 THEN 'FALLING' WHEN slope > 20 THEN 'RISING' ELSE 'STABLE' END"


@query(f"SELECT user_id, {LABEL} AS label, count(*) AS n FROM ({SLOPE}) WHERE support >= 4 GROUP BY ALL")
def entry_trend_label_counts(spark, d):
    rows = ts.trailing_slope(table(spark, d, "events"), "user_id", 3).where("support >= 4")
    return rows.groupBy("user_id", ts.label(F.col("slope"), 20).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def p01_coerce_props(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS bin FROM orders")
def p05_fixed_bins(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(p < 100000, "low").when(p < 300000, "mid").otherwise("high").alias("bin"))


@query(f"SELECT user_id, count(*) AS n, count_if(gap = 0) AS duplicates, count_if(gap < 0) AS backwards, count_if(gap > {12 * HOUR}) AS gaps, max(gap) AS max_gap FROM ({LAG}) GROUP BY user_id")
def w01_lag_profile(spark, d):
    rows = ts.with_lag(table(spark, d, "events"), "user_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("gap") == 0).alias("duplicates"), F.count_if(F.col("gap") < 0).alias("backwards"), F.count_if(F.col("gap") > 12 * HOUR).alias("gaps"), F.max("gap").alias("max_gap"))


@query(SPANS)
def w02_spans(spark, d):
    return ts.spans(table(spark, d, "events"), "user_id", 12 * HOUR)


def _type_spans(spark, d, kind):
    return ts.spans(table(spark, d, "events").where(F.col("event_type") == kind), "user_id", 2 * DAY)


def _type_spans_sql(kind):
    lag = f"SELECT user_id, event_id, ts, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events WHERE event_type = '{kind}'"
    isl = f"SELECT *, sum(CASE WHEN gap > {2 * DAY} OR gap <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM ({lag})"
    return f"SELECT user_id, min(t) AS span_start, max(t) AS span_end FROM ({isl}) GROUP BY user_id, island"


BOTH = f"({_type_spans_sql('click')} UNION ALL {_type_spans_sql('view')})"


@query(f"""WITH a AS (SELECT *, max(span_end) OVER (PARTITION BY user_id ORDER BY span_start, span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {BOTH}),
b AS (SELECT *, sum(CASE WHEN span_start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY span_start, span_end) AS part FROM a)
SELECT user_id, min(span_start) AS span_start, max(span_end) AS span_end FROM b GROUP BY user_id, part""")
def w03_span_union(spark, d):
    both = _type_spans(spark, d, "click").union(_type_spans(spark, d, "view")).select("user_id", "span_start", "span_end")
    # There are fewer spans than events, so the events' slices do for them.
    return ts.merge_spans(both, "user_id", sequences.width_of(table(spark, d, "events"), "user_id", ts.micros("ts")))


@query(f"""SELECT a.user_id, sum(least(a.span_end, b.span_end) - greatest(a.span_start, b.span_start))::BIGINT AS overlap FROM ({_type_spans_sql('click')}) a
JOIN ({_type_spans_sql('view')}) b ON a.user_id = b.user_id AND a.span_start < b.span_end AND b.span_start < a.span_end GROUP BY a.user_id""")
def j07_overlap_duration(spark, d):
    return ts.overlap_micros(_type_spans(spark, d, "click"), _type_spans(spark, d, "view"), "user_id")


@query(f"SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM ({SPANS}) s WHERE s.user_id = e.user_id AND s.span_start <= epoch_us(e.ts) - {DAY} AND s.span_end >= epoch_us(e.ts))")
def j06_containment(spark, d):
    events = table(spark, d, "events")
    points = events.select("event_id", "user_id", (ts.micros("ts") - DAY).alias("a"), ts.micros("ts").alias("b"))
    return joins.contained(points, ts.spans(events, "user_id", 12 * HOUR), "user_id", "a", "b").select("event_id")


def _smooth(spark, d, how):
    return ts.smooth(table(spark, d, "events"), "user_id", how).select("event_id", r6("smoothed").alias("smoothed"))


@query("SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM events")
def w04_smooth_median3(spark, d):
    return _smooth(spark, d, "median3")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM events")
def w04_smooth_mean3(spark, d):
    return _smooth(spark, d, "mean3")


@query(f"SELECT event_id, round(slope, 6) AS slope, support FROM ({SLOPE}) WHERE support >= 4")
def w05_ols(spark, d):
    return ts.trailing_slope(table(spark, d, "events"), "user_id", 3).where("support >= 4").select("event_id", r6("slope").alias("slope"), "support")


@query(f"""SELECT tau, count_if(slope < -tau) AS falling, count_if(abs(slope) <= tau) AS stable, count_if(slope > tau) AS rising
FROM ({SLOPE}) CROSS JOIN (VALUES (10.0::DOUBLE), (20.0::DOUBLE), (40.0::DOUBLE)) v(tau) WHERE support >= 4 GROUP BY tau""")
def w06_label_grid(spark, d):
    rows = ts.trailing_slope(table(spark, d, "events"), "user_id", 3).where("support >= 4").select("slope", F.explode(F.array(*map(F.lit, (10.0, 20.0, 40.0)))).alias("tau"))
    s, tau = F.col("slope"), F.col("tau")
    return rows.groupBy("tau").agg(F.count_if(s < -tau).alias("falling"), F.count_if(F.abs(s) <= tau).alias("stable"), F.count_if(s > tau).alias("rising"))


@query(f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS r FROM ({ISLANDS})),
b AS (SELECT *, r // 4 AS block, value - lag(value) OVER (PARTITION BY user_id, island, r // 4 ORDER BY ts, event_id) AS step FROM i)
SELECT user_id, min(t) AS window_start, max(t) AS window_end, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high,
round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(avg(abs(step)), 6) AS mean_step FROM b GROUP BY user_id, island, block HAVING count(*) = 4""")
def w08_window_features(spark, d):
    rows = ts.tumbling(table(spark, d, "events"), "user_id", 4, 12 * HOUR)
    step = F.col("value") - F.lag("value").over(Window.partitionBy("user_id", "island", "block").orderBy("ts", "event_id"))
    t = ts.micros("ts")
    return rows.withColumn("step", step).groupBy("user_id", "island", "block").agg(
        F.min(t).alias("window_start"), F.max(t).alias("window_end"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"),
        r6(F.percentile("value", 0.25)).alias("q25"), r6(F.percentile("value", 0.75)).alias("q75"), r6(F.avg(F.abs("step"))).alias("mean_step"),
    ).drop("island", "block")


@query(f"""SELECT p.event_id, count(*) AS n, round(avg(w.value), 6) AS mean, round(stddev_pop(w.value), 6) AS std, min(w.value) AS low, max(w.value) AS high, arg_max(w.value, epoch_us(w.ts)) AS last
FROM events p JOIN events w ON w.user_id = p.user_id AND epoch_us(w.ts) BETWEEN epoch_us(p.ts) - {3 * DAY} AND epoch_us(p.ts) WHERE p.event_type = 'purchase' GROUP BY p.event_id HAVING count(*) >= 3""")
def j08_history_features(spark, d):
    return _history_features(spark, d, "event_type = 'purchase'")


@query(f"""SELECT p.event_id, count(*) AS n, round(avg(w.value), 6) AS mean, round(stddev_pop(w.value), 6) AS std, min(w.value) AS low, max(w.value) AS high, arg_max(w.value, epoch_us(w.ts)) AS last
FROM events p JOIN events w ON w.user_id = p.user_id AND epoch_us(w.ts) BETWEEN epoch_us(p.ts) - {3 * DAY} AND epoch_us(p.ts) GROUP BY p.event_id HAVING count(*) >= 3""")
def j08_history_features_all(spark, d):
    return _history_features(spark, d, "true")


def _history_features(spark, d, ends):
    """Features of the three days up to each event that meets `ends`."""
    e = table(spark, d, "events").withColumn("t", ts.micros("ts"))
    points = e.where(ends).select("event_id", "user_id", (F.col("t") - 3 * DAY).alias("a"), F.col("t").alias("b"))
    found = joins.history_join(points, e.select("user_id", "value", "t"), "user_id", "a", "b", "t", 3 * DAY)
    out = found.groupBy("event_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", "t").alias("last"))
    return out.where("n >= 3")


@query("SELECT l.event_id, r.value AS next_value FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts <= r.ts")
def j09_asof_next(spark, d):
    e = table(spark, d, "events")
    left, right = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("next_value"))
    return joins.next_as_of(left, right, "user_id", "ts", "next_value").select("event_id", "next_value")


SPLIT = f"""WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS t, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
b AS (SELECT *, least(greatest(floor(n * 0.6::DOUBLE), 1), n - 2) AS i1 FROM a), c AS (SELECT *, least(greatest(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)), i1 + 1), n - 1) AS i2 FROM b),
e AS (SELECT *, max(CASE WHEN i = i1 THEN t END) OVER (PARTITION BY user_id) AS b1, max(CASE WHEN i = i2 THEN t END) OVER (PARTITION BY user_id) AS b2 FROM c),
f AS (SELECT *, CASE WHEN i < i1 THEN 'train' WHEN i < i2 THEN 'validation' ELSE 'test' END AS part FROM e)
SELECT event_id, user_id, t, CASE WHEN (part = 'train' AND t >= b1 - {DAY}) OR (part = 'validation' AND (t < b1 + {DAY} OR t >= b2 - {DAY})) OR (part = 'test' AND t < b2 + {DAY}) THEN 'excluded_embargo' ELSE part END AS split FROM f"""


@query(f"SELECT event_id, split FROM ({SPLIT})")
def w13_embargo(spark, d):
    return splits.chronological_split(table(spark, d, "events"), "user_id", DAY).select("event_id", "split")


@query(f"SELECT count_if(later) AS violations FROM (SELECT CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END < lag(CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END) OVER (PARTITION BY user_id ORDER BY t) AS later FROM ({SPLIT}) WHERE split <> 'excluded_embargo')")
def w16_chronology(spark, d):
    rows = splits.chronological_split(table(spark, d, "events"), "user_id", DAY).where("split <> 'excluded_embargo'")
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    return sequences.lagged(rows, "user_id", ["t", "i"], {"before": rank}).agg(F.count_if(rank < F.col("before")).alias("violations"))


@query("""WITH a AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT x.event_id, y.value AS shifted FROM a x JOIN a y ON x.user_id = y.user_id AND y.i = (x.i + greatest(1, round_even(x.n * 0.25, 0)::BIGINT)) % x.n""")
def w10_shift_features(spark, d):
    return splits.circular_shift(table(spark, d, "events"), "user_id", 0.25, "value").select("event_id", "shifted")


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, round(stddev_pop(value), 6) AS std0, round(stddev_samp(value), 6) AS std1 FROM events GROUP BY event_type")
def a08_quantiles(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    q = distribution.quantiles(e, "event_type", "value", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    std = e.groupBy("event_type").agg(r6(F.stddev_pop("value")).alias("std0"), r6(F.stddev_samp("value")).alias("std1"))
    return std.join(q.select("event_type", *(r6(c).alias(c) for c in ("q05", "q50", "q95"))), "event_type", "left")


@query("SELECT event_type, round(skewness(value), 6) AS skew, round(corr(value, epoch_us(ts)::DOUBLE), 6) AS pearson FROM events GROUP BY event_type")
def a27_adjusted_moments(spark, d):
    n = F.count("value")
    skew = F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)
    return table(spark, d, "events").groupBy("event_type").agg(r6(skew).alias("skew"), r6(F.corr("value", ts.micros("ts").cast("double"))).alias("pearson"))


@query("""WITH dims AS (SELECT a.event_type, b.h FROM (SELECT DISTINCT event_type FROM events) a CROSS JOIN range(24) b(h)), c AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, h::INTEGER AS h, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY event_type), 6) AS share FROM dims LEFT JOIN c USING (event_type, h)""")
def a03_dense_counts(spark, d):
    e = table(spark, d, "events").withColumn("h", F.hour("ts"))
    dims = e.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    rows = dims.join(e.groupBy("event_type", "h").agg(F.count("*").alias("n")), ["event_type", "h"], "left").fillna(0, ["n"])
    return rows.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("event_type"))))


@query("SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((), (event_type))")
def a16_grouping_sets(spark, d):
    rows = table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))
    return rows.withColumn("event_type", F.coalesce("event_type", F.lit("all")))


@query("""WITH c AS (SELECT quality AS y, toxic AS p, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS total, sum(n) FILTER (y = p) AS agree FROM c),
e AS (SELECT sum(a.n * b.n) AS chance FROM (SELECT y AS k, sum(n) AS n FROM c GROUP BY y) a JOIN (SELECT p AS k, sum(n) AS n FROM c GROUP BY p) b USING (k))
SELECT round((agree / total - chance / (total * total)) / (1 - chance / (total * total)), 6) AS kappa FROM t, e""")
def a21_kappa(spark, d):
    c = table(spark, d, "labels").agg(*(F.count_if((F.col("quality") == y) & (F.col("toxic") == p)).cast("double").alias(f"n{y}{p}") for y in (0, 1) for p in (0, 1)))
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    chance = ((F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10")) + (F.col("n10") + F.col("n11")) * (F.col("n01") + F.col("n11"))) / (n * n)
    return c.select(r6(((F.col("n00") + F.col("n11")) / n - chance) / (1 - chance)).alias("kappa"))


@query("""WITH k AS (SELECT unnest([0, 1]) AS class), c AS (SELECT class, count_if(quality = class AND toxic = class) AS tp, count_if(toxic = class) AS pp, count_if(quality = class) AS support FROM k CROSS JOIN labels GROUP BY class)
SELECT class, round(coalesce(tp / nullif(pp, 0), 0), 6) AS prec, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(pp + support, 0), 0), 6) AS f1, support FROM c""")
def m10_prf(spark, d):
    rows = table(spark, d, "labels").select("quality", "toxic", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    hit = lambda c: F.col(c) == F.col("class")
    c = rows.groupBy("class").agg(F.count_if(hit("quality") & hit("toxic")).alias("tp"), F.count_if(hit("toxic")).alias("pp"), F.count_if(hit("quality")).alias("support"))
    ratio = lambda a, b: r6(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    return c.select("class", ratio(F.col("tp"), F.col("pp")).alias("prec"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("pp") + F.col("support")).alias("f1"), "support")


@query("SELECT user_id, arg_max(event_id, value) AS event_id, max(value) AS value FROM (SELECT * FROM events ORDER BY event_id) GROUP BY user_id")
def t02_argmax(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')")
def j04_semi(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("o_orderkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j05_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j03_left(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u03_intersect(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT event_id, round((value - q50) / greatest(q75 - q25, 1e-12), 6) AS scaled FROM events JOIN (SELECT user_id, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY user_id) USING (user_id)")
def w18_robust_scale(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    q = distribution.quantiles(e, "user_id", "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return e.join(q, "user_id").select("event_id", r6((F.col("value") - F.col("q50")) / F.greatest(F.col("q75") - F.col("q25"), F.lit(1e-12))).alias("scaled"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def s14_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT count(*) - count(DISTINCT (user_id, ts)) AS duplicate_keys, count_if(value IS NULL OR NOT isfinite(value)) AS bad_values, count_if(event_type NOT IN ('click', 'view', 'purchase')) AS other_types FROM events")
def v01_contract(spark, d):
    e, bad = table(spark, d, "events"), F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return e.agg((F.count("*") - F.count_distinct("user_id", "ts")).alias("duplicate_keys"), F.count_if(bad).alias("bad_values"), F.count_if(~F.col("event_type").isin("click", "view", "purchase")).alias("other_types"))


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events)
SELECT event_type, round(corr(a, b), 6) AS spearman FROM r GROUP BY event_type""")
def a14_spearman(spark, d):
    rows, rank = table(spark, d, "events").select("event_type", "value", "user_id"), F.col("below") + 1 + (F.col("same") - 1) / 2
    rows = distribution.placed(rows, "event_type", "value").select("event_type", "user_id", rank.alias("a"))
    rows = distribution.placed(rows, "event_type", "user_id").select("event_type", "a", rank.alias("b"))
    return rows.groupBy("event_type").agg(r6(F.corr("a", "b")).alias("spearman"))


@query("""WITH s AS (SELECT n_chars AS score, sum(quality) AS tp, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY n_chars),
c AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER () AS pos FROM s WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(tp / pos * ctp / cn), 6) AS average_precision FROM c""")
def m14_ap(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    steps = rows.groupBy("n_chars").agg(F.sum("quality").alias("tp"), F.count("*").alias("n"))
    # Cumulated within ranges of the score first, so that no task sorts all thresholds.
    ranges = steps.withColumn("part", F.floor(F.col("n_chars") / 4096))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part").agg(F.sum("tp").alias("t"), F.sum("n").alias("m"))
    base = totals.select("part", F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t0"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("m0"), F.sum("t").over(Window.partitionBy()).alias("pos"))
    w = Window.partitionBy("part").orderBy(F.desc("n_chars"))
    rows = ranges.withColumn("t", F.sum("tp").over(w)).withColumn("m", F.sum("n").over(w)).join(base, "part")
    return rows.agg(r6(F.sum(F.col("tp") / F.col("pos") * (F.col("t") + F.col("t0")) / (F.col("m") + F.col("m0")))).alias("average_precision"))


DFT = """(SELECT vec_id, k, power(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * cos(2 * pi() * k * i / 64))), 2)
  + power(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * sin(2 * pi() * k * i / 64))), 2) AS p FROM embeddings CROSS JOIN range(1, 33) r(k))"""


@query(f"SELECT vec_id, round(sum(p) FILTER (k BETWEEN 2 AND 8) / sum(p), 5) AS band_ratio FROM {DFT} GROUP BY vec_id")
def n02_band_ratio(spark, d):
    # The whole spectrum of a vector in its row: the band is of places 2 to 8 of 64 at a rate of 64.
    rows = table(spark, d, "embeddings").select("vec_id", signals.band(F.col("embedding").cast("array<double>"), 64.0, (2.0, 8.0), (1.0, 32.0), detrend=False).alias("f"))
    return rows.select("vec_id", F.round("f.ratio", 5).alias("band_ratio"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, count(DISTINCT v) / count(*) AS unique_share FROM x GROUP BY vec_id""")
def n03_channel_quality(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", signals.moments("embedding").alias("f"))
    own = {"mean": F.col("f.mean"), "std": F.col("f.std"), "median": F.col("f.median"), "iqr": F.col("f.q75") - F.col("f.q25")}
    return rows.select("vec_id", *(r6(c).alias(n) for n, c in own.items()), F.col("f.unique_share").alias("unique_share"))


@query(f"""SELECT p.event_id, round(quantile_cont((b.value - a.value) / ((epoch_us(b.ts) - epoch_us(a.ts)) / {DAY}.0), 0.5), 6) AS slope FROM events p
JOIN events a ON a.user_id = p.user_id AND epoch_us(a.ts) BETWEEN epoch_us(p.ts) - {3 * DAY} AND epoch_us(p.ts) JOIN events b ON b.user_id = p.user_id AND epoch_us(b.ts) BETWEEN epoch_us(p.ts) - {3 * DAY} AND epoch_us(p.ts) AND a.ts < b.ts
WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def w05_theil_sen(spark, d):
    return _theil_sen(spark, d, "event_type = 'purchase'")


@query(f"""SELECT p.event_id, round(quantile_cont((b.value - a.value) / ((epoch_us(b.ts) - epoch_us(a.ts)) / {DAY}.0), 0.5), 6) AS slope FROM events p
JOIN events a ON a.user_id = p.user_id AND epoch_us(a.ts) BETWEEN epoch_us(p.ts) - {3 * DAY} AND epoch_us(p.ts) JOIN events b ON b.user_id = p.user_id AND epoch_us(b.ts) BETWEEN epoch_us(p.ts) - {3 * DAY} AND epoch_us(p.ts) AND a.ts < b.ts
GROUP BY p.event_id""")
def w05_theil_sen_all(spark, d):
    return _theil_sen(spark, d, "true")


def _theil_sen(spark, d, ends):
    """Median slope over the pairs of the three days up to each event that meets `ends`."""
    e = table(spark, d, "events").withColumn("t", ts.micros("ts"))
    points = e.where(ends).select("event_id", "user_id", (F.col("t") - 3 * DAY).alias("a"), F.col("t").alias("b"))
    rows = joins.history_join(points, e.select("user_id", "value", "t"), "user_id", "a", "b", "t", 3 * DAY)
    seen = rows.groupBy("event_id").agg(F.collect_list(F.struct("t", "value")).alias("seen"))
    return seen.select("event_id", r6(slopes.theil_sen("seen", DAY)).alias("slope")).where("slope IS NOT NULL")


@query("SELECT event_type, count_if(user_id % 2 = 0) AS even, count_if(user_id % 2 = 1) AS odd FROM events GROUP BY event_type")
def a18_pivot(spark, d):
    rows = table(spark, d, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return rows.groupBy("event_type").pivot("side", ["even", "odd"]).count().fillna(0)


@query("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def w15_dedupe(spark, d):
    w = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "ts", "event_id")


@query("SELECT o_orderkey, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 6) AS ecdf FROM orders")
def a32_ecdf(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return distribution.placed(rows, "o_orderstatus", "o_totalprice").select("o_orderkey", r6((F.col("below") + F.col("same")) / F.col("total")).alias("ecdf"))


ORDERED = "SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events"
PLACED = f"SELECT *, least(greatest(floor(n * 0.8::DOUBLE), i1 + 1), n - 1) AS i2 FROM (SELECT *, least(greatest(floor(n * 0.6::DOUBLE), 1), n - 2) AS i1 FROM ({ORDERED}))"
SPLIT = f"SELECT *, CASE WHEN i < i1 THEN 'train' WHEN i < i2 THEN 'validation' ELSE 'test' END AS split FROM ({PLACED})"
TRAIN_Q = f"SELECT user_id, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.25) AS q25 FROM ({SPLIT}) WHERE split = 'train' GROUP BY user_id"


def _slopes_sql(days):
    return f"""SELECT event_id, user_id, {LABEL} AS label, slope FROM (SELECT *, regr_slope(value, (epoch_us(ts) - 1704067200000000) / 86400000000.0) OVER w AS slope, count(value) OVER w AS support
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {days * DAY} PRECEDING AND CURRENT ROW)) WHERE support >= 4"""


def _slopes(spark, d, days):
    rows = ts.trailing_slope(table(spark, d, "events"), "user_id", days).where("support >= 4")
    return rows.select("event_id", "user_id", ts.label(F.col("slope"), 20).alias("label"), "slope")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 WHEN l_quantity >= 25 THEN 2 END AS bin FROM lineitem")
def p04_halfopen_bins(spark, d):
    """Half-open bins of which exactly one must hold each value, or the query fails."""
    found = checks.one_bin(F.col("l_quantity"), [(0, 0, 10), (1, 10, 25), (2, 25, None)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", found.alias("bin"))


@query("SELECT event_id, concat_ws(';', CASE WHEN event_type = 'click' THEN 'click' END, CASE WHEN value < 20 THEN 'low' END, CASE WHEN hour(ts) < 6 THEN 'night' END) AS reasons FROM events")
def p10_reason_codes(spark, d):
    reasons = F.array(F.when(F.hour("ts") < 6, "night"), F.when(F.col("value") < 20, "low"), F.when(F.col("event_type") == "click", "click"))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.array_compact(reasons)), ";").alias("reasons"))


@query(f"SELECT event_id, split FROM ({SPLIT})")
def w12_split(spark, d):
    return splits.chronological_split(table(spark, d, "events"), "user_id", 0).select("event_id", "split")


@query(f"""WITH f AS (SELECT * FROM ({ORDERED}) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS fold)), a AS (SELECT *, i >= n * fold // 5 AND i < n * (fold + 1) // 5 AS assess FROM f),
b AS (SELECT *, min(t) FILTER (assess) OVER (PARTITION BY user_id, fold) - {DAY} AS begins FROM a)
SELECT user_id, fold, count_if(assess) AS n_assess, count_if(NOT assess AND t < begins) AS n_train FROM b GROUP BY ALL""")
def w14_inner_folds(spark, d):
    rows = splits.inner_folds(table(spark, d, "events"), "user_id", 4, DAY)
    return rows.groupBy("user_id", "fold").agg(F.count_if(F.col("role") == "assess").alias("n_assess"), F.count_if(F.col("role") == "train").alias("n_train"))


@query(f"SELECT a.event_id, b.event_type AS shifted FROM ({ORDERED}) a JOIN ({ORDERED}) b ON a.user_id = b.user_id AND b.i = (a.i + greatest(1, round_even(a.n * 0.25, 0)::BIGINT)) % a.n")
def w11_shift_labels(spark, d):
    return splits.circular_shift(table(spark, d, "events"), "user_id", 0.25, "event_type").select("event_id", "shifted")


@query(f"""SELECT event_id, round((last_value(value) OVER w - first_value(value) OVER w) / nullif((max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w) / 86400000000.0, 0), 6) AS delta
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW)""")
def w05_endpoint_delta(spark, d):
    return ts.endpoint_delta(table(spark, d, "events"), "user_id", 3).select("event_id", r6("delta").alias("delta"))


@query(f"""SELECT event_id, count(*) OVER w >= 2 AND min(t) OVER w <= t - {DAY} + {12 * HOUR} AND first_value(island) OVER w = island AS eligible
FROM ({ISLANDS}) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)""")
def w05_eligible(spark, d):
    return ts.eligible(table(spark, d, "events"), "user_id", 1, 2, 12 * HOUR).select("event_id", "eligible")


@query(f"""SELECT user_id, island, block, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1) // 4 AS block FROM ({ISLANDS}))
GROUP BY ALL HAVING count(*) = 4""")
def w07_tumbling(spark, d):
    rows = ts.tumbling(table(spark, d, "events"), "user_id", 4, 12 * HOUR)
    return rows.groupBy("user_id", "island", "block").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(f"SELECT user_id, i // 16 AS block, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms FROM ({ORDERED}) GROUP BY ALL HAVING count(*) >= 2")
def w17_blocks_rms(spark, d):
    rows = ts.row_blocks(table(spark, d, "events"), "user_id", 16).groupBy("user_id", "block")
    return rows.agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("rms")).where("n >= 2")


def _train_quantiles(spark, d):
    train = splits.chronological_split(table(spark, d, "events"), "user_id", 0).where("split = 'train'")
    return distribution.quantiles(train, "user_id", "value", {"q10": 0.1, "q25": 0.25})


@query(f"SELECT user_id, round(q10, 6) AS q10, round(q25, 6) AS q25 FROM ({TRAIN_Q})")
def w19_thresholds(spark, d):
    return _train_quantiles(spark, d).select("user_id", r6("q10").alias("q10"), r6("q25").alias("q25"))


@query(f"SELECT event_id, round(CASE WHEN q25 <= 0 THEN 1.0 ELSE least(greatest(value / q25, 0.25), 1.0) END, 6) AS weight, value >= q10 AS kept FROM events JOIN ({TRAIN_Q}) USING (user_id)")
def w20_policy(spark, d):
    rows = joins.lookup(table(spark, d, "events"), _train_quantiles(spark, d), ["user_id"])
    weight = F.when(F.col("q25") <= 0, 1.0).otherwise(F.least(F.greatest(F.col("value") / F.col("q25"), F.lit(0.25)), F.lit(1.0)))
    return rows.select("event_id", r6(weight).alias("weight"), (F.col("value") >= F.col("q10")).alias("kept"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def t03_topk(spark, d):
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "value")


@query("SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def j01_inner(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "quality", "toxic")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j14_pairs(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    pairs = n.withColumnRenamed("n_nationkey", "a").join(n.withColumnRenamed("n_nationkey", "b"), "n_regionkey")
    return pairs.where("a < b").select("a", "b")


@query("SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE value > 50")
def u01_union_all(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'click'").select("event_id").unionAll(e.where("value > 50").select("event_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def u02_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("SELECT DISTINCT lang, source FROM documents")
def u04_distinct(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query(" UNION ALL ".join(f"SELECT {h} AS days, count_if(label = 'FALLING') AS falling, count_if(label = 'STABLE') AS stable, count_if(label = 'RISING') AS rising, count(*) AS eligible FROM ({_slopes_sql(h)})" for h in (2, 3, 5)))
def a01_protocol_totals(spark, d):
    rows = ts.trailing_slopes(table(spark, d, "events"), "user_id", [2, 3, 5]).where("support >= 4")
    n = lambda x: F.count_if(ts.label(F.col("slope"), 20) == x.upper()).alias(x)
    return rows.groupBy("days").agg(n("falling"), n("stable"), n("rising"), F.count("*").alias("eligible"))


@query(f"SELECT label, count(DISTINCT user_id) AS users FROM ({_slopes_sql(3)}) GROUP BY label")
def a02_participant_support(spark, d):
    return _slopes(spark, d, 3).groupBy("label").agg(F.count_distinct("user_id").alias("users"))


@query("""SELECT count(r) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) AS iqr, round(min(r), 6) AS low, round(max(r), 6) AS high
FROM (SELECT user_id, corr(value, epoch_us(ts) / 86400000000.0) AS r FROM events GROUP BY user_id)""")
def a15_corr_summary(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg(F.corr("value", ts.micros("ts") / F.lit(86_400_000_000.0)).alias("r"))
    iqr = F.percentile("r", 0.75) - F.percentile("r", 0.25)
    return r.agg(F.count("r").alias("n"), r6(F.avg("r")).alias("mean"), r6(F.percentile("r", 0.5)).alias("median"), r6(iqr).alias("iqr"), r6(F.min("r")).alias("low"), r6(F.max("r")).alias("high"))


@query("""WITH k AS (SELECT DISTINCT event_type AS k FROM events), c AS (SELECT before, event_type AS after, count(*) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY ALL)
SELECT a.k AS before, b.k AS after, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON before = a.k AND after = b.k""")
def a19_transitions(spark, d):
    e = table(spark, d, "events")
    rows = sequences.sliced(e.select("user_id", "ts", "event_id", "event_type"), "user_id", ts.micros("ts"))
    met = sequences.lagged(rows, "user_id", ["ts", "event_id"], {"before": F.col("event_type")}).select("before", F.col("event_type").alias("after")).where("before IS NOT NULL")
    kinds = e.agg(F.collect_set("event_type").alias("kinds"))  # a handful of event types
    cells = kinds.select(F.explode("kinds").alias("before"), "kinds").select("before", F.explode("kinds").alias("after"))
    return cells.join(met.groupBy("before", "after").agg(F.count("*").alias("n")), ["before", "after"], "left").fillna(0, ["n"])


@query("""WITH c AS (SELECT count_if(quality = 1 AND toxic = 1) AS s, count_if(quality = 1) AS p, count_if(toxic = 1) AS q FROM labels)
SELECT round(s / p, 6) AS of_primary, round(s / q, 6) AS of_candidate, round(s / (p + q - s), 6) AS jaccard FROM c""")
def a20_overlap(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    c = table(spark, d, "labels").agg(F.count_if(q & t).alias("s"), F.count_if(q).alias("p"), F.count_if(t).alias("q"))
    return c.selectExpr("round(try_divide(s, p), 6) AS of_primary", "round(try_divide(s, q), 6) AS of_candidate", "round(try_divide(s, p + q - s), 6) AS jaccard")


@query(f"""SELECT a.label = b.label AS agree, count(*) AS n, round(quantile_cont(abs(abs(a.slope) - 20), 0.1), 6) AS q10, round(quantile_cont(abs(abs(a.slope) - 20), 0.5), 6) AS q50, round(quantile_cont(abs(abs(a.slope) - 20), 0.9), 6) AS q90
FROM ({_slopes_sql(3)}) a JOIN ({_slopes_sql(2)}) b USING (event_id) GROUP BY ALL""")
def a22_margins(spark, d):
    rows = _slopes(spark, d, 3).join(_slopes(spark, d, 2).select("event_id", F.col("label").alias("other")), "event_id")
    rows = rows.select((F.col("label") == F.col("other")).alias("agree"), F.abs(F.abs("slope") - 20).alias("margin"))
    q = distribution.quantiles(rows, "agree", "margin", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return rows.groupBy("agree").agg(F.count("*").alias("n")).join(q, "agree", "left").select("agree", "n", *(r6(c).alias(c) for c in ("q10", "q50", "q90")))


@query("""WITH k AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS q FROM events GROUP BY event_type), u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
c AS (SELECT user_id, event_type, count(*) AS m FROM events GROUP BY ALL), t AS (SELECT user_id, sum(abs(coalesce(m, 0) / n - q)) / 2 AS distance FROM u CROSS JOIN k LEFT JOIN c USING (user_id, event_type) GROUP BY user_id)
SELECT round(avg(distance), 6) AS mean, round(max(distance), 6) AS high FROM t""")
def a23_tv_distance(spark, d):
    rows = evaluation.total_variation(table(spark, d, "events"), "user_id", "event_type")
    return rows.agg(r6(F.avg("distance")).alias("mean"), r6(F.max("distance")).alias("high"))


@query(f"SELECT split, x AS threshold, count_if(value >= x) AS n, round(count_if(value >= x) / count(*), 6) AS fraction FROM ({SPLIT}) CROSS JOIN (SELECT unnest([10, 25, 50]) AS x) GROUP BY ALL")
def a25_threshold_fractions(spark, d):
    rows = splits.chronological_split(table(spark, d, "events"), "user_id", 0).select("split", "value", F.explode(F.array(*map(F.lit, (10, 25, 50)))).alias("threshold"))
    over = F.count_if(F.col("value") >= F.col("threshold"))
    return rows.groupBy("split", "threshold").agg(over.alias("n"), r6(over / F.count("*")).alias("fraction"))


@query(f"""WITH u AS (SELECT user_id, count(DISTINCT label) AS kinds, count_if(label <> 'STABLE') / count(*) AS directional FROM ({_slopes_sql(3)}) GROUP BY user_id)
SELECT count_if(kinds < 3) AS lacking, round(quantile_cont(directional, 0.5), 6) AS directional, CASE WHEN count_if(kinds < 3) > 0 OR quantile_cont(directional, 0.5) < 0.2 THEN 'LABEL_SUPPORT_RISK' ELSE 'PASS' END AS verdict FROM u""")
def a26_gate(spark, d):
    u = _slopes(spark, d, 3).groupBy("user_id").agg(F.count_distinct("label").alias("kinds"), F.avg((F.col("label") != "STABLE").cast("int")).alias("directional"))
    c = u.agg(F.count_if(F.col("kinds") < 3).alias("lacking"), F.percentile("directional", 0.5).alias("directional"))
    return c.select("lacking", r6("directional").alias("directional"), F.when((F.col("lacking") > 0) | (F.col("directional") < 0.2), "LABEL_SUPPORT_RISK").otherwise("PASS").alias("verdict"))


@query("""SELECT vec_id, round(regr_slope(y, x), 6) AS slope, round(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 5) AS rss
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings) GROUP BY vec_id""")
def n01_detrend(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", signals.detrended("embedding").alias("f"))
    return rows.select("vec_id", r6("f.slope").alias("slope"), F.round(F.aggregate("f.residuals", F.lit(0.0), lambda s, r: s + r * r), 5).alias("rss"))


@query("SELECT min(vec_id) AS vec_id, count(*) AS copies FROM embeddings GROUP BY embedding")
def n07_array_equal(spark, d):
    return table(spark, d, "embeddings").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).drop("embedding")


@query("""SELECT vec_id, round(min(z), 5) AS low, round(max(z), 5) AS high FROM (SELECT vec_id, (y - avg(y) OVER v) / greatest(stddev_pop(y) OVER v, 1e-12) AS z FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS y FROM embeddings) WINDOW v AS (PARTITION BY vec_id)) GROUP BY vec_id""")
def n09_normalize(spark, d):
    z = table(spark, d, "embeddings").select("vec_id", signals.z_scores("embedding").alias("z"))
    return z.select("vec_id", F.round(F.array_min("z"), 5).alias("low"), F.round(F.array_max("z"), 5).alias("high"))


@query("SELECT round(avg(recall), 6) AS balanced_accuracy FROM (SELECT avg((quality = toxic)::INT) AS recall FROM labels GROUP BY quality)")
def m12_balanced_acc(spark, d):
    return evaluation.balanced_accuracy(table(spark, d, "labels"), "quality", "toxic").select(r6("balanced_accuracy").alias("balanced_accuracy"))


@query("""SELECT class, round(count_if(quality = class AND toxic = class) / nullif(count_if(quality = class), 0), 6) AS sensitivity, round(count_if(quality <> class AND toxic <> class) / nullif(count_if(quality <> class), 0), 6) AS specificity
FROM labels CROSS JOIN (SELECT unnest([0, 1]) AS class) GROUP BY class""")
def m13_spec(spark, d):
    rows = table(spark, d, "labels").select("quality", "toxic", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    y, p = F.col("quality") == F.col("class"), F.col("toxic") == F.col("class")
    part = lambda a, b, name: r6(F.try_divide(F.count_if(a), F.count_if(b))).alias(name)
    return rows.groupBy("class").agg(part(y & p, y, "sensitivity"), part(~y & ~p, ~y, "specificity"))


@query("SELECT quality, toxic, n, round(n / sum(n) OVER (PARTITION BY quality), 6) AS share FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)")
def m15_confusion(spark, d):
    return evaluation.confusion(table(spark, d, "labels"), "quality", "toxic").withColumn("share", r6("share"))


@query(f"""SELECT count(*) AS directional, round(avg((a.label <> b.label AND b.label <> 'STABLE')::INT), 6) AS opposite FROM ({_slopes_sql(3)}) a JOIN ({_slopes_sql(2)}) b USING (event_id) WHERE a.label <> 'STABLE'""")
def m16_opposite(spark, d):
    rows = _slopes(spark, d, 3).where("label <> 'STABLE'").join(_slopes(spark, d, 2).select("event_id", F.col("label").alias("other")), "event_id")
    wrong = (F.col("label") != F.col("other")) & (F.col("other") != "STABLE")
    return rows.agg(F.count("*").alias("directional"), r6(F.avg(wrong.cast("int"))).alias("opposite"))


@query("SELECT event_type, round((1 + count_if(value >= 50)) / (1 + count(value)), 6) AS p FROM events GROUP BY event_type")
def m20_tail(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r6(evaluation.upper_tail(F.col("value"), 50.0)).alias("p"))


@query(f"SELECT count_if(kinds < 3) AS lacking, count_if(unknown > 0) AS unknown FROM (SELECT user_id, count(DISTINCT split) AS kinds, count_if(split NOT IN ('train', 'validation', 'test')) AS unknown FROM ({SPLIT}) GROUP BY user_id)")
def v03_split_contract(spark, d):
    rows = splits.chronological_split(table(spark, d, "events"), "user_id", 0).groupBy("user_id")
    u = rows.agg(F.count_distinct("split").alias("kinds"), F.count_if(~F.col("split").isin("train", "validation", "test")).alias("unknown"))
    return u.agg(F.count_if(F.col("kinds") < 3).alias("lacking"), F.count_if(F.col("unknown") > 0).alias("unknown"))


@query(f"""WITH m AS (SELECT event_type FROM ({SPLIT}) WHERE split = 'train' GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT any_value(m.event_type) AS majority, count(*) AS n, round(avg((s.event_type = m.event_type)::INT), 6) AS accuracy FROM ({SPLIT}) s CROSS JOIN m WHERE split = 'validation'""")
def m04_constant_model(spark, d):
    counts = splits.chronological_split(table(spark, d, "events"), "user_id", 0).groupBy("event_type")
    part = lambda s: F.count_if(F.col("split") == s)
    kinds = counts.agg(part("train").alias("seen"), part("validation").alias("held")).orderBy(F.desc("seen"), "event_type")
    first = F.max_by(F.struct("event_type", "held"), F.struct("seen", F.negative(F.col("place"))))
    kinds = kinds.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("event_type")))  # a row for each type
    rows = kinds.agg(first.alias("m"), F.sum("held").alias("n"))
    return rows.select(F.col("m.event_type").alias("majority"), "n", r6(F.col("m.held") / F.col("n")).alias("accuracy"))


@query("""SELECT doc_id, (row_number() OVER (PARTITION BY quality, part ORDER BY digest, doc_id) - 1 + part) % 5 AS fold
FROM (SELECT doc_id, quality, md5(doc_id::VARCHAR) AS digest, ('0x' || md5(doc_id::VARCHAR)[1:2])::INT AS part FROM labels)""")
def m07_folds(spark, d):
    return evaluation.stratified_folds(table(spark, d, "labels"), "doc_id", "quality", 5).select("doc_id", F.col("fold").cast("long").alias("fold"))


@query("""WITH u AS (SELECT user_id, avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view') AS delta FROM events GROUP BY user_id),
r AS (SELECT draw, delta, ('0x' || md5(user_id || ':' || draw)[1:8])::BIGINT / 4294967296.0 * 2.718281828459045::DOUBLE AS x FROM u CROSS JOIN range(1, 501) t(draw) WHERE delta IS NOT NULL),
w AS (SELECT draw, delta, (x >= 1)::INT + (x >= 2)::INT + (x >= 2.5)::INT + (x >= 2 + 0.5 + 1 / 6)::INT + (x >= 2.5 + 1 / 6 + 1 / 24)::INT + (x >= 2.5 + 1 / 6 + 1 / 24 + 1 / 120)::INT AS times FROM r),
m AS (SELECT draw, sum(delta * times) / sum(times) AS mean FROM w GROUP BY draw)
SELECT count(*) AS draws, round(quantile_cont(mean, 0.025), 5) AS low, round(quantile_cont(mean, 0.975), 5) AS high FROM m""")
def m17_bootstrap(spark, d):
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    users = table(spark, d, "events").groupBy("user_id").agg((of("click") - of("view")).alias("delta"))
    means = evaluation.bootstrap_means(users, "user_id", "delta", 500)
    return means.agg(F.count("*").alias("draws"), F.round(F.percentile("mean", 0.025), 5).alias("low"), F.round(F.percentile("mean", 0.975), 5).alias("high"))


@query("""WITH c AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1) // 16 AS channel, (generate_subscripts(embedding, 1) - 1) % 16 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.vec_id, a.channel::INT AS a, b.channel::INT AS b, round(corr(a.v, b.v), 5) AS pearson, round((max(a.v) - min(a.v)) / (max(b.v) - min(b.v)), 5) AS range_ratio, round(stddev_pop(a.v) / stddev_pop(b.v), 5) AS deviation_ratio
FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i = b.i AND a.channel < b.channel GROUP BY a.vec_id, a.channel, b.channel""")
def n06_cross_channel(spark, d):
    channel = lambda k: F.slice("embedding", 16 * k + 1, 16)
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), signals.relation(channel(a), channel(b)).alias("f")) for a in range(4) for b in range(a + 1, 4)]
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(F.array(*pairs)).alias("p"))
    return rows.select("vec_id", "p.a", "p.b", *(F.round(f"p.f.{c}", 5).alias(c) for c in ("pearson", "range_ratio", "deviation_ratio")))


# The rest of the queries register themselves here.
from . import archived, audits, contracts, exchanged, kernels, runners, study  # noqa: E402, F401
