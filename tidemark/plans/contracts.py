"""Contracts as queries: each returns counts of what violates it, so that zeros mean it holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, evaluation, joins, sequences, signals, splits
from ..operators import timeseries as ts
from .catalogue import DAY, SPLIT, _slopes, _slopes_sql, query, r6, table


def n(c, name):
    return F.count_if(c).alias(name)


@query("SELECT count_if(a > 1) AS repeat_left, count_if(b > 1) AS repeat_right, count_if(b = 0) AS only_left, count_if(a = 0) AS only_right, count_if(a > 0 AND b > 0) AS shared FROM (SELECT doc_id, sum(l) AS a, sum(r) AS b FROM (SELECT doc_id, 1 AS l, 0 AS r FROM documents UNION ALL SELECT doc_id, 0, 1 FROM labels) GROUP BY doc_id)")
def j01_key_equality(spark, d):
    return joins.one_to_one(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), ["doc_id"])


@query(f"SELECT event_id, a.label AS label_primary, b.label AS label_candidate, round(a.slope, 6) AS slope_primary, round(b.slope, 6) AS slope_candidate FROM ({_slopes_sql(3)}) a JOIN ({_slopes_sql(2)}) b USING (event_id)")
def j02_suffixes(spark, d):
    """Shared endpoints of two formulations, 1:1, with names told apart."""
    p, c = (_slopes(spark, d, h).select("event_id", "label", r6("slope").alias("slope")) for h in (3, 2))
    return joins.join_one_to_one(p, c, ["event_id"], suffixes=("_primary", "_candidate"))


@query("SELECT doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j03_left_one_to_one(spark, d):
    return joins.join_one_to_one(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"], "left")


@query("SELECT s.segment, s.nation, count(c.c_custkey) AS customers, round(avg(c.c_acctbal), 4) AS mean FROM (VALUES ('BUILDING', 1), ('MACHINERY', 7), ('FURNITURE', 12)) s(segment, nation) JOIN customer c ON c.c_mktsegment = s.segment AND c.c_nationkey = s.nation GROUP BY ALL")
def j11_shortlist(spark, d):
    """Rows that match a fixed shortlist on several columns; an entry without a match fails the query."""
    short = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 7), ("FURNITURE", 12)], "segment string, nation int")
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("int").alias("nation"))
    found = c.join(F.broadcast(short), ["segment", "nation"]).groupBy("segment", "nation").agg(F.count("c_custkey").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return joins.lookup(F.broadcast(short), found, ["segment", "nation"])


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL AND isfinite(value)")
def p02_finite(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", "value").where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-02-01' AND user_id = 7 OR value BETWEEN 10 AND 10.5")
def p03_filters(spark, d):
    t = F.col("ts")
    own = F.col("event_type").isin("click", "view") & (t >= F.lit("2024-01-05").cast("timestamp_ntz")) & (t < F.lit("2024-02-01").cast("timestamp_ntz")) & (F.col("user_id") == 7)
    return table(spark, d, "events").where(own | F.col("value").between(10, 10.5)).select("event_id", "event_type", "value")


@query("SELECT p_partkey, CASE lower(split_part(p_type, ' ', 1)) WHEN 'standard' THEN 0 WHEN 'small' THEN 1 WHEN 'large' THEN 2 END AS code, round(p_retailprice / power(p_size / 100.0, 2), 4) AS per_area FROM part")
def p08_code_map(spark, d):
    """A code from a fixed map, null for others, and a derived ratio."""
    codes = F.create_map(*(F.lit(x) for pair in (("standard", 0), ("small", 1), ("large", 2)) for x in pair))
    kind = F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))
    return table(spark, d, "part").select("p_partkey", F.try_element_at(codes, kind).alias("code"), F.round(F.col("p_retailprice") / F.pow(F.col("p_size") / 100.0, F.lit(2)), 4).alias("per_area"))


@query("SELECT event_id, round(abs(value - 50), 6) AS a, round(sqrt(abs(value)), 6) AS b, round(power(abs(value), 0.25), 6) AS c, round(exp(-abs(value) / 50), 6) AS e, round(ln(1 + abs(value)), 6) AS f, least(greatest(value, 10), 60) AS g, ceil(value)::BIGINT AS h, floor(value)::BIGINT AS i, round_even(value * 2, 0)::BIGINT AS j FROM events")
def p12_math(spark, d):
    v, size = F.col("value"), F.abs("value")
    own = {"a": r6(F.abs(v - 50)), "b": r6(F.sqrt(size)), "c": r6(F.pow(size, F.lit(0.25))), "e": r6(F.exp(-size / 50)), "f": r6(F.log1p(size)), "g": F.least(F.greatest(v, F.lit(10.0)), F.lit(60.0)), "h": F.ceil(v), "i": F.floor(v), "j": F.bround(v * 2).cast("long")}
    return table(spark, d, "events").select("event_id", *(c.alias(k) for k, c in own.items()))


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_tax), 2) AS l_tax FROM lineitem GROUP BY l_returnflag")
def p14_columns_by_prefix(spark, d):
    """All double columns of a prefix, but for an exclusion, found from the schema."""
    rows = table(spark, d, "lineitem")
    found = [c for c, kind in rows.dtypes if c.startswith("l_") and kind == "double" and c not in {"l_discount"}]
    return rows.groupBy("l_returnflag").agg(*(F.round(F.sum(c), 2).alias(c) for c in found))


@query(f"""SELECT event_id, round(avg(value) OVER w, 6) AS value_mean, round(stddev_pop(value) OVER w, 6) AS value_std, min(value) OVER w AS value_min, max(value) OVER w AS value_max, last_value(value) OVER w AS value_last
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW)""")
def p15_feature_list(spark, d):
    """A list of features built from names and statistics; `_last` alone is the current window."""
    w = ts.back("user_id", "ts", 3 * DAY)
    how = {"mean": lambda c: r6(F.avg(c).over(w)), "std": lambda c: r6(F.stddev_pop(c).over(w)), "min": lambda c: F.min(c).over(w), "max": lambda c: F.max(c).over(w), "last": lambda c: F.last(c).over(w)}
    features = {f"{c}_{a}": f(c) for c in ("value",) for a, f in how.items()}
    rows = sequences.with_reach(table(spark, d, "events"), ts.micros("ts"), 3 * DAY)
    return rows.withColumns(features).where("not copy").select("event_id", *features)


PROTOCOLS = [("a", 0.6, 0.2, 0.2, 30, 30, 5), ("b", 0.7, 0.2, 0.2, 30, 30, 5), ("c", 0.6, 0.2, 0.2, 10, 30, 5), ("d", 0.6, 0.4, 0.0, 30, 0, 5)]
_names = "name string, train double, validation double, test double, embargo int, history int, cadence int"
_values = ", ".join(str(p) for p in PROTOCOLS)


@query(f"""SELECT name, concat_ws(';', CASE WHEN embargo < history THEN 'EMBARGO_BELOW_HISTORY' END, CASE WHEN abs(train + validation + test - 1) > 1e-9 THEN 'FRACTIONS' END, CASE WHEN history <= 0 OR history % cadence <> 0 THEN 'HISTORY' END, CASE WHEN least(train, validation, test) <= 0 THEN 'NO_SPLIT' END) AS violations
FROM (VALUES {_values}) v(name, train, validation, test, embargo, history, cadence)""")
def v02_protocol(spark, d):
    """What of a protocol's fixed values is not allowed, as sorted codes; empty if it is sound."""
    p = spark.createDataFrame(PROTOCOLS, _names)
    parts = F.col("train") + F.col("validation") + F.col("test")
    codes = [F.when(F.abs(parts - 1) > 1e-9, "FRACTIONS"), F.when(F.least("train", "validation", "test") <= 0, "NO_SPLIT"), F.when(F.col("embargo") < F.col("history"), "EMBARGO_BELOW_HISTORY"), F.when((F.col("history") <= 0) | (F.col("history") % F.col("cadence") != 0), "HISTORY")]
    return p.select("name", F.array_join(F.array_sort(F.array_compact(F.array(*codes))), ";").alias("violations"))


@query(f"SELECT count_if(split = 'test') AS held_back, count(*) - count(DISTINCT (user_id, ts)) AS repeated, count_if(user_id IS NULL OR ts IS NULL) AS no_identity, count_if(event_type NOT IN ('click', 'view', 'purchase')) AS unknown FROM ({SPLIT}) WHERE split <> 'test' OR value > 90")
def v04_development_guard(spark, d):
    rows = splits.chronological_split(table(spark, d, "events"), "user_id", 0).where("split <> 'test' OR value > 90")
    return rows.agg(n(F.col("split") == "test", "held_back"), (F.count("*") - F.count_distinct("user_id", "ts")).alias("repeated"), n(F.col("user_id").isNull() | F.col("ts").isNull(), "no_identity"), n(~F.col("event_type").isin("click", "view", "purchase"), "unknown"))


@query(f"""WITH e AS (SELECT 'H3' AS candidate, *, 20.0 AS tau FROM ({_slopes_sql(3)}) UNION ALL SELECT 'H2', *, 20.0 FROM ({_slopes_sql(2)})), t AS (SELECT e.*, epoch_us(ts) AS t_us FROM e JOIN events USING (event_id))
SELECT candidate, count(*) - count(DISTINCT (user_id, event_id)) AS repeated, count_if(label NOT IN ('FALLING', 'STABLE', 'RISING')) AS unknown, count_if(t_us IS NULL) AS no_time, count_if(t_us - CASE candidate WHEN 'H3' THEN 3 ELSE 2 END * {DAY} > t_us) AS late_history, count_if(tau <= 0) AS thresholds, count(*) AS n FROM t GROUP BY candidate""")
def v06_endpoint_labels(spark, d):
    at = table(spark, d, "events").select("event_id", ts.micros("ts").alias("at"))
    one = lambda name, h: _slopes(spark, d, h).select(F.lit(name).alias("candidate"), "event_id", "user_id", "label", F.lit(20.0).alias("tau"), F.lit(h).alias("days"))
    rows = one("H3", 3).unionByName(one("H2", 2)).join(at, "event_id")
    late = F.col("at") - F.col("days") * F.lit(DAY) > F.col("at")
    return rows.groupBy("candidate").agg((F.count("*") - F.count_distinct("user_id", "event_id")).alias("repeated"), n(~F.col("label").isin("FALLING", "STABLE", "RISING"), "unknown"), n(F.col("at").isNull(), "no_time"), n(late, "late_history"), n(F.col("tau") <= 0, "thresholds"), F.count("*").alias("n"))


_planted = f"""(SELECT 'H' || h AS candidate, e.event_id - CASE WHEN e.event_id % 101 = 1 THEN 1 ELSE 0 END AS key, CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE when_us END AS when_us, first_at + CASE WHEN e.event_id % 89 = 0 THEN {10 * DAY} ELSE 0 END AS history_start,
CASE WHEN e.event_id % 83 = 0 THEN 'UP' ELSE label END AS label, CASE WHEN e.event_id % 79 = 0 THEN 20.0 - value ELSE 20.0 END AS threshold FROM (SELECT 3 AS h, * FROM ({_slopes_sql(3)}) UNION ALL SELECT 2, * FROM ({_slopes_sql(2)})) e
JOIN (SELECT event_id, value, epoch_us(ts) AS when_us, min(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW) AS first_at FROM events) USING (event_id))"""


@query(f"""SELECT candidate, count(*) AS n, count(*) - count(DISTINCT key) AS repeated, count_if(label NOT IN ('FALLING', 'STABLE', 'RISING')) AS unknown, count_if(when_us IS NULL) AS no_time, count_if(history_start > when_us) AS late_history, count_if(threshold <= 0) AS thresholds FROM {_planted} GROUP BY candidate""")
def v06_endpoint_faults(spark, d):
    """The rules of endpoint labels on a table in which each is broken somewhere: some events have their time taken, their
    history moved on, another label, another event's key, or a threshold that their value lowers."""
    e = table(spark, d, "events")
    first = ts.trailing_slope(e, "user_id", 3).select("event_id", ts.micros("ts").alias("at"), F.col("first_point").alias("first_at"), F.col("value").alias("v"))
    one = lambda h: _slopes(spark, d, h).select(F.lit(f"H{h}").alias("candidate"), "event_id", "label")
    rows, k = one(3).unionByName(one(2)).join(first, "event_id"), F.col("event_id")
    rows = rows.select(
        "candidate", (k - F.when(k % 101 == 1, 1).otherwise(0)).alias("key"), F.when(k % 97 != 0, F.col("at")).alias("at"), (F.col("first_at") + F.when(k % 89 == 0, F.lit(10 * DAY)).otherwise(0)).alias("history_start"),
        F.when(k % 83 == 0, "UP").otherwise(F.col("label")).alias("label"), F.when(k % 79 == 0, 20.0 - F.col("v")).otherwise(20.0).alias("threshold"),
    )
    return checks.endpoint_faults(rows, ["FALLING", "STABLE", "RISING"])


@query("SELECT history, width, asked, history * 60 // width - 1 AS due, asked = history * 60 // width - 1 AS holds FROM (VALUES (30, 30, 59), (30, 60, 29), (20, 30, 30)) v(history, width, asked)")
def v07_minimum_windows(spark, d):
    """The least number of windows asked for must be that of a whole history, less one."""
    rows = spark.createDataFrame([(30, 30, 59), (30, 60, 29), (20, 30, 30)], "history int, width int, asked int")
    due = F.floor(F.col("history") * 60 / F.col("width")) - 1
    return rows.select("*", due.alias("due"), (F.col("asked") == due).alias("holds"))


FEATURED = f"SELECT p.event_id FROM events p JOIN events w ON w.user_id = p.user_id AND epoch_us(w.ts) BETWEEN epoch_us(p.ts) - {3 * DAY} AND epoch_us(p.ts) GROUP BY p.event_id HAVING count(*) >= 3"


@query(f"SELECT count(*) AS endpoints, count_if(f.event_id IS NULL) AS lost FROM ({_slopes_sql(3)}) e LEFT JOIN ({FEATURED}) f USING (event_id)")
def v08_lost_endpoints(spark, d):
    """Endpoints that have no features; the contract asks for none."""
    e = table(spark, d, "events").withColumn("t", ts.micros("ts"))
    points = e.select("event_id", "user_id", (F.col("t") - 3 * DAY).alias("a"), F.col("t").alias("b"))
    found = joins.history_join(points, e.select("user_id", "t"), "user_id", "a", "b", "t", 3 * DAY).groupBy("event_id").count().where("count >= 3").select("event_id", F.lit(True).alias("hit"))
    return _slopes(spark, d, 3).join(found, "event_id", "left").agg(F.count("*").alias("endpoints"), n(F.col("hit").isNull(), "lost"))


@query("""WITH l AS (SELECT user_id, max(ts) AS last_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT count_if(last_at IS NULL) AS no_reference, count_if(e.ts > last_at) AS after_last, count(DISTINCT CASE WHEN last_at IS NULL THEN e.user_id END) AS users_missing FROM events e LEFT JOIN l USING (user_id) WHERE event_type = 'click'""")
def v09_after_last(spark, d):
    e = table(spark, d, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last_at"))
    rows = e.where("event_type = 'click'").join(last, "user_id", "left")
    return rows.agg(n(F.col("last_at").isNull(), "no_reference"), n(F.col("ts") > F.col("last_at"), "after_last"), F.count_distinct(F.when(F.col("last_at").isNull(), F.col("user_id"))).alias("users_missing"))


@query("""SELECT source, count(*) AS files, count_if(n_chars IS DISTINCT FROM length(coalesce(text, '')) OR source IS NULL) AS differ, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, CASE WHEN sum(strlen(coalesce(text, ''))) <= 100000 THEN 'PASS' ELSE 'NO_GO' END AS budget FROM documents GROUP BY source""")
def v10_source_identity(spark, d):
    """What is stated of a source and what is there must agree in all parts; its bytes must fit the budget."""
    text = F.coalesce(F.col("text"), F.lit(""))
    differ = ~F.col("n_chars").eqNullSafe(F.length(text).cast("long")) | F.col("source").isNull()
    size = F.sum(F.octet_length(text))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), n(differ, "differ"), size.alias("bytes"), F.when(size <= 100000, "PASS").otherwise("NO_GO").alias("budget"))


@query("SELECT count(*) AS windows, count_if(embedding IS NULL OR len(embedding) < 16) AS short, count_if(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS not_finite, count_if(list_min(embedding) = list_max(embedding)) AS constant FROM embeddings")
def v14_window_validity(spark, d):
    e, x = table(spark, d, "embeddings"), F.col("embedding")
    return e.agg(F.count("*").alias("windows"), n(x.isNull() | (F.size(x) < 16), "short"), n(F.size(signals.finite("embedding")) < F.size(x), "not_finite"), n(F.array_min(x) == F.array_max(x), "constant"))


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT user_id, count(*) AS total FROM ({_slopes_sql(2)}) GROUP BY user_id)
SELECT count(*) AS users, count_if(total IS NULL) AS without_labels, coalesce(min(total), 0) AS least FROM u LEFT JOIN k USING (user_id)""")
def v16_candidate_audit(spark, d):
    """Users that a candidate gives no label at all, which it must not."""
    u = table(spark, d, "events").select("user_id").distinct()
    k = _slopes(spark, d, 2).groupBy("user_id").agg(F.count("*").alias("total"))
    return u.join(k, "user_id", "left").agg(F.count("*").alias("users"), n(F.col("total").isNull(), "without_labels"), F.coalesce(F.min("total"), F.lit(0).cast("long")).alias("least"))


RESERVE = "(SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) <= ceil(0.2 * count(*) OVER (PARTITION BY quality)) AS reserved FROM labels)"


@query(f"SELECT doc_id, quality, reserved FROM {RESERVE}")
def m08_reserve(spark, d):
    """A stratified fifth, by digests, held back."""
    return evaluation.reserve(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.2)


@query(f"""SELECT quality, count(*) AS n, count_if(reserved) AS held_back, count_if(NOT reserved) AS development, count(*) - count(DISTINCT doc_id) AS repeated, count_if(reserved) = ceil(0.2 * count(*)) AS counts_hold FROM {RESERVE} GROUP BY quality""")
def v05_reserve(spark, d):
    """Both parts of the reserve per stratum: none empty, none shared, counts as asked."""
    rows = m08_reserve(spark, d)
    held = F.count_if("reserved")
    return rows.groupBy("quality").agg(F.count("*").alias("n"), held.alias("held_back"), F.count_if(~F.col("reserved")).alias("development"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"), (held == F.ceil(F.lit(0.2) * F.count("*"))).alias("counts_hold"))
