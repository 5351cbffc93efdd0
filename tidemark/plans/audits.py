"""Audit aggregates, history features, sources and sorts as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distribution, evaluation, joins, sequences, splits
from ..operators import timeseries as ts
from .catalogue import DAY, HOUR, ISLANDS, LAG, SPLIT, _slopes, _slopes_sql, query, r6, table

GAPS = f"SELECT user_id, gap FROM ({LAG}) WHERE gap IS NOT NULL"
WINDOWS = f"""(WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1 AS r FROM ({ISLANDS})),
b AS (SELECT *, r // 4 AS block, value - lag(value) OVER (PARTITION BY user_id, island, r // 4 ORDER BY ts, event_id) AS step FROM i)
SELECT user_id, min(t) AS window_start, max(t) AS window_end, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75,
avg(abs(step)) AS mean_abs_step, stddev_pop(step) AS step_std, avg((step = 0)::INT) AS flat_fraction, regr_slope(value, (t - 1704067200000000) / 60000000.0) AS slope_minute FROM b GROUP BY user_id, island, block HAVING count(*) = 4)"""


def windows_of(spark, d):
    return ts.window_features(ts.tumbling(table(spark, d, "events"), "user_id", 4, 12 * HOUR), "user_id")


@query(f"SELECT user_id, window_start, window_end, {', '.join(f'round({c}, 6) AS {c}' for c in ts.STATISTICS)} FROM {WINDOWS}")
def w08_ten_statistics(spark, d):
    return windows_of(spark, d).select("user_id", "window_start", "window_end", *(r6(c).alias(c) for c in ts.STATISTICS))


HISTORY = [(c, a) for c in ts.STATISTICS for a in ("mean", "std", "min", "max", "last")]
_agg_sql = {"mean": "avg({c})", "std": "stddev_pop({c})", "min": "min({c})", "max": "max({c})", "last": "arg_max({c}, window_end)"}


@query(f"""SELECT p.event_id, count(*) AS windows, {', '.join(f'round({_agg_sql[a].format(c="w." + c)}, 6) AS history_{c}_{a}' for c, a in HISTORY)}
FROM events p JOIN {WINDOWS} w ON w.user_id = p.user_id AND w.window_end BETWEEN epoch_us(p.ts) - {10 * DAY} AND epoch_us(p.ts) AND w.window_start >= epoch_us(p.ts) - {10 * DAY} GROUP BY p.event_id HAVING count(*) >= 2""")
def w09_history_of_windows(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", ts.micros("ts").alias("b"))
    points = e.withColumn("a", F.col("b") - 10 * DAY)
    found = joins.history_join(points, windows_of(spark, d), "user_id", "a", "b", "window_end", 10 * DAY).where("window_start >= a")
    how = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, "window_end")}
    return found.groupBy("event_id").agg(F.count("*").alias("windows"), *(r6(how[a](c)).alias(f"history_{c}_{a}") for c, a in HISTORY)).where("windows >= 2")


@query(f"""SELECT event_id, round((value - q50) / greatest(q75 - q25, 1e-12), 6) AS scaled FROM events
JOIN (SELECT user_id, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM ({SPLIT}) WHERE split = 'train' GROUP BY user_id) USING (user_id)""")
def w18_train_robust_scale(spark, d):
    """As w18_robust_scale, but median and range come from the user's train rows alone, so nothing leaks."""
    train = splits.chronological_split(table(spark, d, "events"), "user_id", 0).where("split = 'train'")
    q = distribution.quantiles(train, "user_id", "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    rows = joins.lookup(table(spark, d, "events").select("event_id", "user_id", "value"), q, ["user_id"])
    return rows.select("event_id", r6((F.col("value") - F.col("q50")) / F.greatest(F.col("q75") - F.col("q25"), F.lit(1e-12))).alias("scaled"))


def gaps_of(spark, d):
    return ts.with_lag(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id").where("gap IS NOT NULL").select("user_id", "gap")


@query(f"SELECT user_id, quantile_disc(gap, 0.5) AS median_gap, round(1e6 / nullif(quantile_disc(gap, 0.5), 0), 9) AS implied_rate FROM ({GAPS}) GROUP BY user_id")
def a09_weighted_median(spark, d):
    """The lower median of the gaps, selected in their histogram by counted ranges."""
    return median_gaps(gaps_of(spark, d))


def median_gaps(gaps):
    """user_id, median_gap, implied_rate (a second) of gaps in microseconds."""
    h = gaps.groupBy("user_id", "gap").agg(F.count("*").alias("n"))
    found = distribution.quantiles(h, "user_id", "gap", {"median_gap": 0.5}, lower=True, count="n")
    return found.withColumn("implied_rate", F.round(F.try_divide(F.lit(1e6), F.col("median_gap")), 9))


@query(f"SELECT user_id, gap // {HOUR} AS hours, count(*) AS n FROM ({GAPS}) GROUP BY ALL")
def a10_delta_histogram(spark, d):
    return gaps_of(spark, d).groupBy("user_id", F.floor(F.col("gap") / HOUR).alias("hours")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT o_orderpriority AS p, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders GROUP BY ALL)
SELECT p AS o_orderpriority, low, high, count_if(o_totalprice = low) AS n_low, count_if(o_totalprice = high) AS n_high,
round((count_if(o_totalprice = low) + CASE WHEN low = high THEN 0 ELSE count_if(o_totalprice = high) END) / any_value(n), 9) AS extrema_fraction FROM orders JOIN m ON p = o_orderpriority GROUP BY p, low, high""")
def a11_extrema(spark, d):
    """Each extremum and how often it occurs, in one pass that combines map-side: equal values are counted first."""
    values = table(spark, d, "orders").groupBy("o_orderpriority", "o_totalprice").agg(F.count("*").alias("k"))
    v, k = F.col("o_totalprice"), F.col("k")
    m = values.groupBy("o_orderpriority").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.min_by(k, v).alias("n_low"), F.max_by(k, v).alias("n_high"), F.sum(k).alias("n"))
    both = F.col("n_low") + F.when(F.col("low") == F.col("high"), 0).otherwise(F.col("n_high"))
    return m.select("o_orderpriority", "low", "high", "n_low", "n_high", F.round(both / F.col("n"), 9).alias("extrema_fraction"))


@query("""WITH r AS (SELECT user_id, corr(value, epoch_us(ts) / 86400000000.0) AS r FROM events GROUP BY user_id)
SELECT round((SELECT corr(value, epoch_us(ts) / 86400000000.0) FROM events), 6) AS pooled, count(r) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) AS iqr, round(min(r), 6) AS low, round(max(r), 6) AS high FROM r""")
def a15_pooled_and_own(spark, d):
    day = ts.micros("ts") / F.lit(86_400_000_000.0)
    sets = table(spark, d, "events").rollup("user_id").agg(F.corr("value", day).alias("r"), F.grouping("user_id").alias("all_users"))
    own = F.when(F.col("all_users") == 0, F.col("r"))
    q = lambda p: F.percentile(own, p)
    return sets.agg(r6(F.max(F.when(F.col("all_users") == 1, F.col("r")))).alias("pooled"), F.count(own).alias("n"), r6(F.avg(own)).alias("mean"), r6(q(0.5)).alias("median"), r6(q(0.75) - q(0.25)).alias("iqr"), r6(F.min(own)).alias("low"), r6(F.max(own)).alias("high"))


@query(f"""WITH p AS (SELECT event_id, user_id, label FROM ({_slopes_sql(3)})), c AS (SELECT event_id, user_id, label AS other FROM ({_slopes_sql(2)})), b AS (SELECT coalesce(p.user_id, c.user_id) AS user_id, label, other FROM p FULL JOIN c USING (event_id))
SELECT coalesce(user_id::VARCHAR, 'all') AS user_id, count(label) AS n_primary, count(other) AS n_candidate, count_if(label IS NOT NULL AND other IS NOT NULL) AS shared, round(count_if(label IS NOT NULL AND other IS NOT NULL) / count(*), 6) AS jaccard,
round(count_if(label = other) / nullif(count_if(label IS NOT NULL AND other IS NOT NULL), 0), 6) AS agreement FROM b GROUP BY GROUPING SETS ((), (user_id))""")
def a17_pair_metrics(spark, d):
    p, c = _slopes(spark, d, 3).select("event_id", "user_id", "label"), _slopes(spark, d, 2).select("event_id", F.col("user_id").alias("other_user"), F.col("label").alias("other"))
    b = p.join(c, "event_id", "full").withColumn("user_id", F.coalesce("user_id", "other_user"))
    both = F.count_if(F.col("label").isNotNull() & F.col("other").isNotNull())
    rows = b.rollup("user_id").agg(F.count("label").alias("n_primary"), F.count("other").alias("n_candidate"), both.alias("shared"), r6(both / F.count("*")).alias("jaccard"), r6(F.try_divide(F.count_if(F.col("label") == F.col("other")), both)).alias("agreement"))
    return rows.withColumn("user_id", F.coalesce(F.col("user_id").cast("string"), F.lit("all")))


@query(" UNION ALL ".join(f"SELECT user_id, 'H{h}' AS candidate, round(count_if(label = 'FALLING') / count(*), 6) AS falling, round(count_if(label = 'STABLE') / count(*), 6) AS stable, round(count_if(label = 'RISING') / count(*), 6) AS rising FROM ({_slopes_sql(h)}) GROUP BY user_id" for h in (2, 3, 5)))
def a24_compositions(spark, d):
    """Shares of the classes per user and candidate; all candidates in one pass."""
    rows = ts.trailing_slopes(table(spark, d, "events"), "user_id", [2, 3, 5]).where("support >= 4").withColumn("label", ts.label(F.col("slope"), 20))
    share = lambda x: r6(F.count_if(F.col("label") == x) / F.count("*"))
    return rows.groupBy("user_id", F.concat(F.lit("H"), "days").alias("candidate")).agg(share("FALLING").alias("falling"), share("STABLE").alias("stable"), share("RISING").alias("rising"))


@query("SELECT event_type, round(skewness(value), 5) AS skew, round(kurtosis(value), 5) AS kurtosis FROM events GROUP BY event_type")
def a27_skew_and_kurtosis(spark, d):
    n, g2 = F.count("value").cast("double"), F.kurtosis("value")
    skew = F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(skew, 5).alias("skew"), F.round(kurtosis, 5).alias("kurtosis"))


PROFILE = f"""(WITH s AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM ({LAG})), m AS (SELECT user_id, min(value) AS low, max(value) AS high FROM events GROUP BY user_id)
SELECT s.user_id, count(*) AS n, count(value) AS n_finite, min(t) AS first_at, max(t) AS last_at, round((max(t) - min(t)) / {HOUR}.0, 6) AS hours, count_if(gap = 0) AS duplicates, count_if(gap < 0) AS backwards, count_if(gap > {12 * HOUR}) AS gaps, max(gap) AS max_gap,
quantile_disc(gap, 0.5) AS median_gap, round(avg((step = 0)::INT), 6) AS flat_fraction, any_value(low) AS low, any_value(high) AS high, round((count_if(value = low) + count_if(value = high AND low <> high)) / count(value), 6) AS extrema_fraction, any_value(low = high) AS constant FROM s JOIN m USING (user_id) GROUP BY s.user_id)"""


def profile_of(spark, d):
    """A record per stream, from one two-phase pass and one aggregate per (user, gap) and (user, value)."""
    rows = sequences.sliced(table(spark, d, "events"), "user_id", ts.micros("ts"))
    rows = sequences.lagged(rows, "user_id", ["ts", "event_id"], {"t0": ts.micros("ts"), "v0": F.col("value")})
    rows = rows.select("user_id", "value", ts.micros("ts").alias("t"), (ts.micros("ts") - F.col("t0")).alias("gap"), (F.col("value") - F.col("v0")).alias("step"))
    main = rows.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count("value").alias("n_finite"), F.min("t").alias("first_at"), F.max("t").alias("last_at"), r6((F.max("t") - F.min("t")) / F.lit(float(HOUR))).alias("hours"),
        F.count_if(F.col("gap") == 0).alias("duplicates"), F.count_if(F.col("gap") < 0).alias("backwards"), F.count_if(F.col("gap") > 12 * HOUR).alias("gaps"), F.max("gap").alias("max_gap"), r6(F.avg((F.col("step") == 0).cast("int"))).alias("flat_fraction"),
    )
    values = rows.where("value IS NOT NULL").groupBy("user_id", "value").agg(F.count("*").alias("k")).groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("k", "value").alias("k_low"), F.max_by("k", "value").alias("k_high"), F.sum("k").alias("k"))
    constant = F.col("low") == F.col("high")
    values = values.select("user_id", "low", "high", r6((F.col("k_low") + F.when(constant, 0).otherwise(F.col("k_high"))) / F.col("k")).alias("extrema_fraction"), constant.alias("constant"))
    median = median_gaps(rows.where("gap IS NOT NULL")).select("user_id", "median_gap")
    return main.join(values, "user_id", "left").join(median, "user_id", "left")


@query(f"SELECT * FROM {PROFILE}")
def a28_profile(spark, d):
    return profile_of(spark, d)


@query(f"SELECT count(*) AS streams, sum(n)::BIGINT AS n, sum(duplicates)::BIGINT AS duplicates, sum(backwards)::BIGINT AS backwards, sum(gaps)::BIGINT AS gaps, count_if(constant) AS constant, round(sum(hours), 4) AS hours FROM {PROFILE}")
def a29_roll_up(spark, d):
    p = profile_of(spark, d)
    return p.agg(F.count("*").alias("streams"), *(F.sum(c).alias(c) for c in ("n", "duplicates", "backwards", "gaps")), F.count_if("constant").alias("constant"), F.round(F.sum("hours"), 4).alias("hours"))


@query(f"""SELECT user_id, count(*) AS n, count_if(split <> 'excluded_embargo') AS usable, count_if(split = 'train') AS train, count_if(split = 'validation') AS validation, count_if(split = 'test') AS test, count_if(split = 'excluded_embargo') AS embargo,
min(t) AS first_at, max(t) AS last_at FROM (SELECT s.*, epoch_us(e.ts) AS at FROM ({_slopes_sql(3)}) s JOIN events e USING (event_id)) JOIN (SELECT event_id, t, split FROM ({SPLIT})) USING (event_id) GROUP BY user_id""")
def a30_manifest(spark, d):
    """Counts per split as a map, then as columns; first and last time of each user's endpoints."""
    e = splits.chronological_split(table(spark, d, "events"), "user_id", 0).select("event_id", "t", "split")
    rows = _slopes(spark, d, 3).join(e, "event_id")
    n = rows.groupBy("user_id", "split").agg(F.count("*").alias("k"), F.min("t").alias("a"), F.max("t").alias("b"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("split", "k"))).alias("splits"), F.sum("k").alias("n"), F.min("a").alias("first_at"), F.max("b").alias("last_at"))
    of = lambda s: F.coalesce(F.try_element_at("splits", F.lit(s)), F.lit(0).cast("long"))
    return m.select("user_id", "n", (F.col("n") - of("excluded_embargo")).alias("usable"), of("train").alias("train"), of("validation").alias("validation"), of("test").alias("test"), of("excluded_embargo").alias("embargo"), "first_at", "last_at")


FOLDS = "SELECT doc_id, quality, toxic, (row_number() OVER (PARTITION BY quality, part ORDER BY digest, doc_id) - 1 + part) % 5 AS fold FROM (SELECT doc_id, quality, toxic, md5(doc_id::VARCHAR) AS digest, ('0x' || md5(doc_id::VARCHAR)[1:2])::INT AS part FROM labels)"


@query(f"""WITH f AS (SELECT fold, avg((quality = toxic)::INT) AS accuracy FROM ({FOLDS}) GROUP BY fold)
SELECT round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS sd, round(quantile_cont(accuracy, 0.025), 6) AS q025, round(quantile_cont(accuracy, 0.5), 6) AS q50, round(quantile_cont(accuracy, 0.975), 6) AS q975 FROM f""")
def a31_fold_summary(spark, d):
    folds = evaluation.stratified_folds(table(spark, d, "labels"), "doc_id", "quality", 5)
    f = folds.groupBy("fold").agg(F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("accuracy"))
    return evaluation.summary(f, "accuracy")


RETAINED = f"(SELECT split, variant, (value >= CASE variant WHEN 'all' THEN -1e300 WHEN 'soft' THEN 10 ELSE 25 END) AS kept FROM ({SPLIT}) CROSS JOIN (SELECT unnest(['all', 'soft', 'hard']) AS variant))"


@query(f"SELECT variant, split, count(*) AS n, round(avg(kept::INT), 6) AS retention FROM {RETAINED} GROUP BY ALL")
def a33_retention(spark, d):
    rows = splits.chronological_split(table(spark, d, "events"), "user_id", 0).select("split", "value", F.explode(F.array(*map(F.lit, ("all", "soft", "hard")))).alias("variant"))
    kept = F.when(F.col("variant") == "all", True).when(F.col("variant") == "soft", F.col("value") >= 10).otherwise(F.col("value") >= 25)
    return rows.groupBy("variant", "split").agg(F.count("*").alias("n"), r6(F.avg(kept.cast("int"))).alias("retention"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 100 AND 2000")
def s08_projected_scan(spark, d):
    """Three columns are read and both predicates reach the Parquet scan."""
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").where(F.col("lang").isin("en", "fr") & F.col("n_chars").between(100, 2000))


CUT = "(SELECT user_id, max(ts) AS stop_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)"


@query(f"SELECT user_id, count(*) AS n, max(epoch_us(ts)) AS last_at, round(avg(value), 6) AS mean FROM events JOIN {CUT} USING (user_id) WHERE ts <= stop_at GROUP BY user_id")
def s02_scan_until(spark, d):
    """Each stream is read up to its own cut-off and never past it."""
    e = table(spark, d, "events")
    stops = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("stop_at"))
    rows = e.join(stops, "user_id").where("ts <= stop_at")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max(ts.micros("ts")).alias("last_at"), r6(F.avg("value")).alias("mean"))


@query(f"""SELECT e.event_id, round(regr_slope(h.value, (epoch_us(h.ts) - 1704067200000000) / 86400000000.0), 6) AS slope, count(*) AS support FROM events e JOIN events h ON h.user_id = e.user_id AND epoch_us(h.ts) BETWEEN epoch_us(e.ts) - {3 * DAY} AND epoch_us(e.ts)
JOIN (SELECT user_id, (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS cut FROM events GROUP BY user_id) c ON c.user_id = e.user_id WHERE epoch_us(e.ts) <= cut AND epoch_us(h.ts) <= cut GROUP BY e.event_id HAVING count(*) >= 4""")
def r02_causal_slopes(spark, d):
    """Slopes up to the middle of each stream, from rows cut there: equal to those of the whole stream, as none looks ahead."""
    e = table(spark, d, "events")
    t = ts.micros("ts")
    cut = e.groupBy("user_id").agg(F.floor((F.min(t) + F.max(t)) / 2).alias("cut"))
    rows = ts.trailing_slope(e.join(cut, "user_id").where(t <= F.col("cut")), "user_id", 3)
    return rows.where("support >= 4").select("event_id", r6("slope").alias("slope"), "support")


@query("""SELECT spec, user_id, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT user_id, spec, CASE spec WHEN 'raw' THEN value WHEN 'log' THEN ln(1 + abs(value)) ELSE sqrt(abs(value)) END AS v
FROM events CROSS JOIN (SELECT unnest(['raw', 'log', 'root']) AS spec)) GROUP BY ALL""")
def s03_shared_scan(spark, d):
    """Three representations of each row from one scan."""
    v = F.col("value")
    specs = F.array(*(F.struct(F.lit(n).alias("spec"), c.alias("v")) for n, c in (("raw", v), ("log", F.log1p(F.abs(v))), ("root", F.sqrt(F.abs(v))))))
    rows = table(spark, d, "events").select("user_id", F.explode(specs).alias("s")).select("user_id", "s.*")
    return rows.groupBy("spec", "user_id").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"))


@query("SELECT row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place, o_orderkey FROM orders")
def t01_stable_sort(spark, d):
    """A total order, a unique key last, with each row's place; places are counted by priority and range, not in one task."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return evaluation.places(o, ["o_orderpriority", F.negative(F.col("o_totalprice")).alias("down"), "o_orderkey"]).select("place", "o_orderkey")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def t04_first_and_last(spark, d):
    by = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", by).alias("first_event"), F.max_by("event_id", by).alias("last_event"), F.min_by("value", by).alias("first_value"), F.max_by("value", by).alias("last_value"))


@query("SELECT event_type, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def a08_tails(spark, d):
    q = distribution.quantiles(table(spark, d, "events").select("event_type", "value"), "event_type", "value", {"p01": 0.01, "p25": 0.25, "p75": 0.75, "p99": 0.99})
    return q.select("event_type", *(r6(c).alias(c) for c in ("p01", "p25", "p75", "p99")))


