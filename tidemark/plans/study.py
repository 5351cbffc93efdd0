"""Models, their metrics, comparisons and decisions as queries.

The study: events of a user, split in time, with features of each event; the class is the event's type. Trend labels
over three days stand for the truth and those over two and five days for predictions where only a comparison is asked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import distribution, evaluation, folds, models, splits, suites
from ..operators.tables import stored
from .audits import FOLDS
from .catalogue import DAY, SPLIT, TRAIN_Q, _slopes, _slopes_sql, _train_quantiles, query, r6, table

TREND = ["FALLING", "STABLE", "RISING"]
KINDS = ["click", "purchase", "view"]
FEATURES = ["value", "hour", "weekday"]
STUDY = f"(SELECT *, CASE WHEN value >= 5 THEN value END AS v, hour(ts)::DOUBLE AS h FROM ({SPLIT}))"


def study(spark, d) -> DataFrame:
    """Events with their split; values under 5 count as missing."""
    rows = splits.chronological_split(table(spark, d, "events"), "user_id", 0)
    own = {"value": F.when(F.col("value") >= 5, F.col("value")), "hour": F.hour("ts").cast("double"), "weekday": F.dayofweek("ts").cast("double")}
    return rows.withColumns(own)


def prepared(spark, d) -> DataFrame:
    return models.prepared(study(spark, d), FEATURES, F.col("split") == "train")


@query(f"SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM {STUDY} WHERE split = 'train')), 6) AS value FROM {STUDY}")
def m01_imputed(spark, d):
    rows = study(spark, d)
    q = distribution.medians(rows.where("split = 'train'"), [], ["value"]).first()["median"]
    return rows.select("event_id", r6(F.coalesce("value", F.lit(q))).alias("value"))


@query(f"""WITH q AS (SELECT quantile_cont(v, 0.5) AS q FROM {STUDY} WHERE split = 'train'), f AS (SELECT event_id, split, coalesce(v, q) AS v, h FROM {STUDY} CROSS JOIN q),
m AS (SELECT avg(v) AS a, stddev_pop(v) AS b, avg(h) AS c, stddev_pop(h) AS e FROM f WHERE split = 'train') SELECT event_id, round((v - a) / b, 6) AS value, round((h - c) / e, 6) AS hour FROM f CROSS JOIN m""")
def m02_standardized(spark, d):
    return prepared(spark, d).select("event_id", r6("value").alias("value"), r6("hour").alias("hour"))


@query()
def m03_logistic(spark, d):
    """Predictions of the multinomial model on validation rows."""
    rows = prepared(spark, d)
    predict = models.softmax(rows.where("split = 'train'"), FEATURES, "event_type", KINDS)
    return predict(rows.where("split = 'validation'")).select("event_id", F.col("event_type").alias("label"), "prediction", F.transform("probability", lambda p: F.round(p, 4)).alias("probability"))


@query()
def m05_baseline_suite(spark, d):
    """model, macro_f1, balanced_accuracy on validation: the majority, a constant, all features, one, and shifted ones."""
    rows = stored(prepared(spark, d).select("event_id", "user_id", "ts", "split", F.col("event_type").alias("label"), *FEATURES), "study")
    train, held = rows.where("split = 'train'"), rows.where("split = 'validation'")
    majority = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
    # All features of a row move together, in one pass; read by a fit and a report, so stored.
    moved = splits.circular_shift(rows.withColumn("its_features", F.struct(*FEATURES)), "user_id", 0.25, "its_features")
    shifted = stored(moved.select("split", "label", *(F.col("shifted")[c].alias(c) for c in FEATURES)), "shifted")
    every = None
    for name, of, features in (("logistic_all", rows, FEATURES), ("logistic_value", rows, ["value"]), ("logistic_shifted", shifted, FEATURES)):
        own = of.select(F.lit(name).alias("model"), "split", "label", suites.padded([F.col(c) for c in features], len(features)).alias("x"), F.lit(1.0).alias("weight"))
        every = own if every is None else every.unionByName(own)
    suite = suites.fitted(every.where("split = 'train'"), KINDS, balanced=True, scaled=False)
    every = every.where("split = 'validation'").select("model", "label", suite.predicted().alias("prediction"))
    for name, constant in (("majority", majority), ("always_view", "view")):
        every = every.unionByName(held.select(F.lit(name).alias("model"), "label", F.lit(constant).alias("prediction")))
    s = evaluation.class_scores(every, ["model"], "label", "prediction", KINDS)
    return s.groupBy("model").agg(r6(F.avg("f1")).alias("macro_f1"), r6(F.avg(F.when(F.col("support") > 0, F.col("recall")))).alias("balanced_accuracy"))


RIDGE = """(WITH f AS (SELECT event_id, value AS y, hour(ts)::DOUBLE AS x, ('0x' || md5(event_id::VARCHAR)[1:8])::BIGINT % 5 AS fold FROM events), k AS (SELECT unnest(range(5)) AS model),
m AS (SELECT model, avg(y) AS my, avg(x) AS mx, stddev_pop(x) AS sx FROM f JOIN k ON fold <> model GROUP BY model), b AS (SELECT model, sum((x - mx) / sx * (y - my)) / (count(*) + 1) / any_value(sx) AS beta FROM f JOIN k ON fold <> model JOIN m USING (model) GROUP BY model)
SELECT f.event_id, y, my AS dummy, my + beta * (x - mx) AS ridge FROM f JOIN m ON m.model = fold JOIN b ON b.model = fold)"""
_errors = lambda c: f"SELECT '{c}' AS model, round(avg(abs(y - {c})), 6) AS mae, round(sqrt(avg((y - {c}) ** 2)), 6) AS rmse, round(1 - sum((y - {c}) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM {RIDGE}"


@query(f"{_errors('dummy')} UNION ALL {_errors('ridge')}")
def m06_ridge(spark, d):
    """Errors of the mean and of ridge regressions over five folds; all folds are fitted in one pass."""
    fold = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long") % 5
    rows = table(spark, d, "events").select("event_id", F.col("value").alias("y"), F.hour("ts").cast("double").alias("x"), fold.alias("fold"))
    fits = rows.withColumn("model", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).where("fold <> model")
    means = fits.groupBy("model").agg(F.avg("y").alias("dummy"))
    found = models.ridge(fits, "model", ["x"], "y").join(means, "model").withColumnRenamed("model", "fold")
    held = rows.join(F.broadcast(found), "fold").select("y", F.explode(F.array(*(F.struct(F.lit(n).alias("model"), c.alias("p")) for n, c in (("dummy", F.col("dummy")), ("ridge", models.linear(["x"])))))).alias("m"))
    e = F.col("y") - F.col("m.p")
    return held.groupBy("m.model").agg(r6(F.avg(F.abs(e))).alias("mae"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(1 - F.sum(e * e) / (F.var_pop("y") * F.count("*"))).alias("r2"))


@query("SELECT least(5, min(n)) AS splits, min(n) >= 2 AS enough FROM (SELECT count(*) AS n FROM labels GROUP BY quality)")
def m07_fold_count(spark, d):
    """As many folds as the rarest class allows, five at most; fewer than two is an error."""
    n = F.min("n")
    return table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n")).agg(F.least(F.lit(5).cast("long"), n).alias("splits"), (n >= 2).alias("enough"))


TEXT = ["size", "lower", "blanks"]
REPEATS = 20
TEXTS = """(SELECT doc_id, quality, ln(1 + n) AS size, CASE WHEN n >= 400 THEN length(regexp_replace(t, '[A-Z]', '', 'g')) / n END AS lower, len(string_split(t, ' ')) / greatest(n, 1) AS blanks
FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents) JOIN labels USING (doc_id))"""
DEALT = f"""(SELECT doc_id, repeat, (row_number() OVER (PARTITION BY repeat, quality ORDER BY md5(repeat || ':' || doc_id), doc_id) - 1) % (SELECT least(5, min(n)) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS fold
FROM labels CROSS JOIN (SELECT unnest(range(1, {REPEATS + 1})) AS repeat))"""


def labelled(spark, d) -> DataFrame:
    """doc_id, quality and three features of the text of each labelled document; one is missing for short texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)
    lower = F.when(n >= 400, F.length(F.regexp_replace(text, "[A-Z]", "")) / n)
    docs = table(spark, d, "documents").select("doc_id", F.log1p(n).alias("size"), lower.alias("lower"), (F.size(F.split(text, " ")) / F.greatest(n, F.lit(1))).alias("blanks"))
    # By keys: both sides look smaller than they are, and grow with the table.
    return table(spark, d, "labels").select("doc_id", "quality").hint("merge").join(docs, "doc_id")


def dealt(spark, d, repeats: int = REPEATS) -> tuple[DataFrame, int]:
    """labelled() with the folds of each repeat, written, as every step of a fit reads it; and the number of folds."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    count = folds.fold_count(labels, "quality")
    return stored(labelled(spark, d).join(folds.repeated_folds(labels, "doc_id", "quality", count, repeats).select("doc_id", "folds").hint("merge"), "doc_id"), "dealt"), count


@query(f"SELECT doc_id, repeat, fold FROM {DEALT}")
def m07_repeated_folds(spark, d):
    """The fold of each labelled document in each of 20 repeats, strata dealt out evenly; one digest order a repeat."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    found = folds.repeated_folds(labels, "doc_id", "quality", folds.fold_count(labels, "quality"), REPEATS)
    return found.select("doc_id", F.posexplode("folds").alias("at", "fold")).select("doc_id", (F.col("at") + 1).cast("long").alias("repeat"), F.col("fold").cast("long").alias("fold"))


@query(f"""WITH rows AS (SELECT repeat, k, size, lower, blanks FROM {DEALT} JOIN {TEXTS} USING (doc_id) JOIN (SELECT DISTINCT repeat, fold AS k FROM {DEALT}) o USING (repeat) WHERE fold <> k),
f AS (SELECT repeat, k AS fold, unnest(['size', 'lower', 'blanks']) AS "column", unnest([size, lower, blanks]) AS x FROM rows), m AS (SELECT repeat, fold, "column", quantile_cont(x, 0.5) AS median FROM f GROUP BY ALL)
SELECT repeat, fold, "column", round(any_value(median), 6) AS median, round(avg(coalesce(x, median)), 6) AS mean, round(stddev_pop(coalesce(x, median)), 6) AS std FROM f JOIN m USING (repeat, fold, "column") GROUP BY ALL""")
def m09_preparation(spark, d):
    """What each of 100 fits has learned of its training rows: medians, then means and deviations, none from held-out rows."""
    rows, count = dealt(spark, d)
    found = folds.preparation(rows, TEXT, count)
    return found.select(F.col("repeat").cast("long").alias("repeat"), F.col("fold").cast("long").alias("fold"), "column", r6("median").alias("median"), r6("mean").alias("mean"), r6("std").alias("std"))


def cross_validated(spark, d) -> DataFrame:
    """repeat, fold, label, guess of every held-out row of every repeat."""
    rows, count = dealt(spark, d)
    fits = folds.fits_of(folds.preparation(rows, TEXT, count), TEXT)
    ready = stored(folds.with_row(rows, TEXT, "quality", "doc_id"), "fits")
    found = folds.held_out(ready, fits, folds.logistic_fits(ready, fits))
    return found.select("repeat", "fold", F.col("label").cast("int").alias("label"), (F.col("p") >= 0.5).cast("int").alias("guess"))


def fold_scores(rows: DataFrame, groups: list[str]) -> DataFrame:
    """groups, macro_f1, balanced_accuracy (over the classes that a group's labels hold)."""
    s = evaluation.class_scores(rows, groups, "label", "guess", [0, 1])
    return s.groupBy(*groups).agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


@query()
def m09_cross_validation(spark, d):
    """repeat, fold (0 and -1 for all pooled), scores of logistic models that are prepared and fitted without the fold."""
    rows = cross_validated(spark, d)
    own = F.array(F.struct("repeat", "fold"), F.struct(F.lit(0).cast("long").alias("repeat"), F.lit(-1).cast("long").alias("fold")))
    both = rows.select("label", "guess", F.explode(own).alias("k")).select("label", "guess", "k.*")
    return fold_scores(both, ["repeat", "fold"]).select("repeat", "fold", r6("macro_f1").alias("macro_f1"), r6("balanced_accuracy").alias("balanced_accuracy"))


@query()
def m09_fold_summary(spark, d):
    """metric, mean, sd, q025, q50, q975 of the scores of all folds of all repeats."""
    scores = stored(fold_scores(cross_validated(spark, d), ["repeat", "fold"]), "scores")
    found = [evaluation.summary(scores, c).select(F.lit(c).alias("metric"), "*") for c in ("macro_f1", "balanced_accuracy")]
    return found[0].unionByName(found[1])


PAIRS = f"(SELECT a.event_id, a.user_id, a.label, b.label AS guess FROM ({_slopes_sql(3)}) a JOIN ({_slopes_sql(2)}) b USING (event_id))"


def f1_sql(rows: str, groups: str, classes: list[str]) -> str:
    """groups, class, support, recall, f1 by SQL."""
    g = f"{groups}, " if groups else ""
    values = ", ".join(f"'{c}'" for c in classes)
    return f"""(SELECT {g}class, count_if(label = class) AS support, coalesce(count_if(label = class AND guess = class) / nullif(count_if(label = class), 0), 0) AS recall,
coalesce(2 * count_if(label = class AND guess = class) / nullif(count_if(label = class) + count_if(guess = class), 0), 0) AS f1 FROM {rows} CROSS JOIN (SELECT unnest([{values}]) AS class) GROUP BY ALL)"""


def pairs(spark, d) -> DataFrame:
    return _slopes(spark, d, 3).select("event_id", "user_id", "label").join(_slopes(spark, d, 2).select("event_id", F.col("label").alias("guess")), "event_id")


@query(f"SELECT round(avg(f1), 6) AS macro_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, sum(support)::BIGINT AS n FROM {f1_sql(PAIRS, '', TREND)}")
def m10_macro(spark, d):
    s = evaluation.class_scores(pairs(spark, d), [], "label", "guess", TREND)
    return s.agg(r6(F.avg("f1")).alias("macro_f1"), r6(F.avg(F.when(F.col("support") > 0, F.col("recall")))).alias("balanced_accuracy"), F.sum("support").alias("n"))


@query(f"SELECT user_id, round(avg(f1), 6) AS macro_f1 FROM {f1_sql(PAIRS, 'user_id', TREND)} GROUP BY user_id")
def m11_macro_f1_per_user(spark, d):
    return evaluation.macro_f1(pairs(spark, d), ["user_id"], "label", "guess", TREND).select("user_id", r6("macro_f1").alias("macro_f1"))


@query("""WITH s AS (SELECT class, n_chars AS score, count_if(quality = class) AS tp, count(*) AS n FROM documents JOIN labels USING (doc_id) CROSS JOIN (SELECT unnest([0, 1]) AS class) GROUP BY ALL),
c AS (SELECT class, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY class) AS pos FROM s WINDOW w AS (PARTITION BY class ORDER BY CASE class WHEN 1 THEN score ELSE -score END DESC)),
a AS (SELECT class, sum(tp / pos * ctp / cn) AS ap FROM c GROUP BY class) SELECT class::VARCHAR AS class, round(ap, 6) AS average_precision FROM a UNION ALL SELECT 'macro', round(avg(ap), 6) FROM a""")
def m14_average_precision(spark, d):
    """Average precision of each class and their mean; class 0 is scored by the negative score."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    each = rows.select("quality", F.explode(F.array(*(F.struct(F.lit(c).alias("class"), (F.col("n_chars") * (1 if c else -1)).alias("score")) for c in (0, 1)))).alias("s"))
    steps = each.groupBy("s.class", "s.score").agg(F.count_if(F.col("quality") == F.col("s.class")).alias("tp"), F.count("*").alias("n")).withColumn("part", F.floor(F.col("score") / 4096))
    above = Window.partitionBy("class").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = steps.groupBy("class", "part").agg(F.sum("tp").alias("t"), F.sum("n").alias("m"))
    base = totals.select("class", "part", F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t0"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("m0"), F.sum("t").over(Window.partitionBy("class")).alias("pos"))
    w = Window.partitionBy("class", "part").orderBy(F.desc("score"))
    placed = steps.withColumn("t", F.sum("tp").over(w)).withColumn("m", F.sum("n").over(w)).join(base, ["class", "part"])
    ap = placed.groupBy("class").agg(F.sum(F.col("tp") / F.col("pos") * (F.col("t") + F.col("t0")) / (F.col("m") + F.col("m0"))).alias("ap"))
    return ap.rollup("class").agg(r6(F.avg("ap")).alias("average_precision")).select(F.coalesce(F.col("class").cast("string"), F.lit("macro")).alias("class"), "average_precision")


RULES = f"(SELECT fold, quality AS label, (n_chars >= 300)::INT AS one, (n_chars >= 800)::INT AS two FROM ({FOLDS}) JOIN documents USING (doc_id))"
_binary = lambda c: f1_sql(f"(SELECT fold, label::VARCHAR AS label, {c}::VARCHAR AS guess FROM {RULES})", "fold", ["0", "1"])


@query(f"""WITH a AS (SELECT fold, avg(f1) AS f FROM {_binary('one')} GROUP BY fold), b AS (SELECT fold, avg(f1) AS f FROM {_binary('two')} GROUP BY fold)
SELECT count(*) AS folds, round(avg(a.f - b.f), 6) AS mean_delta, round(stddev_samp(a.f - b.f), 6) AS sd, round(avg((a.f > b.f)::INT), 6) AS positive FROM a JOIN b USING (fold)""")
def m18_paired_folds(spark, d):
    """Two predictors on identical folds: the mean difference in macro-F1 and the share of folds where the first wins."""
    rows = evaluation.stratified_folds(table(spark, d, "labels"), "doc_id", "quality", 5).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), (F.col("n_chars") >= cut).cast("int").alias("guess")) for n, cut in (("one", 300), ("two", 800))))
    each = rows.select("fold", "quality", F.explode(rules).alias("r")).select("fold", "quality", "r.*")
    f = evaluation.macro_f1(each, ["fold", "rule"], "quality", "guess", [0, 1]).groupBy("fold").pivot("rule", ["one", "two"]).agg(F.first("macro_f1"))
    delta = F.col("one") - F.col("two")
    return f.agg(F.count("*").alias("folds"), r6(F.avg(delta)).alias("mean_delta"), r6(F.stddev_samp(delta)).alias("sd"), r6(F.avg((delta > 0).cast("int"))).alias("positive"))


@query()
def m19_permutation_null(spark, d):
    """permutations, observed, mean and quantiles of the null's macro-F1, and the upper tail: 1,000 permutations of the
    labels, one repeat of folds, all models fitted side by side as columns of matrices."""
    rows, count = dealt(spark, d, repeats=1)
    found = permuted_scores(rows, count, 1000)
    null = found["null"]
    tail = (1 + int((null >= found["observed"]).sum())) / (1 + len(null))
    row = (len(null), found["observed"], null.mean(), null.std(ddof=1), *np.quantile(null, [0.025, 0.5, 0.975]), tail)
    return spark.createDataFrame([(row[0], *(round(float(x), 6) for x in row[1:]))], "permutations int, observed double, mean double, sd double, q025 double, q50 double, q975 double, p double")


def permuted_scores(rows: DataFrame, count: int, permutations: int) -> dict:
    """observed: macro-F1 of the labels as they are; null: that of each permutation. A number a permutation, no rows."""
    if not 500 <= permutations <= 1000:
        raise ValueError("a decisive null takes 500 to 1000 permutations")
    fits = folds.fits_of(folds.preparation(rows, TEXT, count), TEXT)
    ready = stored(folds.with_row(rows, TEXT, "quality", "doc_id"), "fits")
    guesses = folds.held_out(ready, fits, folds.logistic_fits(ready, fits)).select("label", (F.col("p") >= 0.5).cast("int").alias("guess"))
    seen = guesses.agg(*(F.count_if((F.col("guess") == g) & (F.col("label") == t)) for g in (0, 1) for t in (0, 1))).first()
    ones = ready.where("label = 1").count()
    confusion = folds.permutation_null(ready, fits, folds.permutations(ready, len(TEXT), permutations, ones))
    return {"observed": float(folds.macro_f1(np.array([list(seen)], float))[0]), "null": folds.macro_f1(confusion), "confusion": confusion}


POLICY = f"(SELECT p.*, value >= q10 AS kept, split FROM {PAIRS} p JOIN (SELECT event_id, value, split FROM ({SPLIT})) e USING (event_id) JOIN ({TRAIN_Q}) q ON q.user_id = p.user_id)"
_policy = lambda name, kept: f"(SELECT '{name}' AS policy, * FROM {POLICY} WHERE split = 'validation' AND {kept})"
_both = f"(SELECT * FROM {_policy('report_only', 'true')} UNION ALL SELECT * FROM {_policy('hard_exclude', 'kept')})"


def policies(spark, d) -> DataFrame:
    """Validation pairs once for each policy that keeps them."""
    e = splits.chronological_split(table(spark, d, "events"), "user_id", 0).where("split = 'validation'").select("event_id", "value")
    rows = pairs(spark, d).join(e, "event_id").join(_train_quantiles(spark, d), "user_id").withColumn("kept", F.col("value") >= F.col("q10"))
    names = F.when(F.col("kept"), F.array(F.lit("report_only"), F.lit("hard_exclude"))).otherwise(F.array(F.lit("report_only")))
    return rows.withColumn("policy", F.explode(names))


@query(f"""WITH s AS {f1_sql(_both, 'policy', TREND)}, n AS (SELECT policy, count(*) AS rows FROM {_both} GROUP BY policy)
SELECT policy, any_value(rows) AS rows, round(any_value(rows) / (SELECT max(rows) FROM n), 6) AS retention, round(avg(f1), 6) AS macro_f1, round(max(recall) FILTER (class = 'FALLING'), 6) AS falling_recall, round(max(recall) FILTER (class = 'RISING'), 6) AS rising_recall FROM s JOIN n USING (policy) GROUP BY policy""")
def m21_policies(spark, d):
    """Scores of validation rows, unweighted, under each quality policy, and what it retains."""
    rows = policies(spark, d)
    s = evaluation.class_scores(rows, ["policy"], "label", "guess", TREND)
    recall = lambda c: r6(F.max(F.when(F.col("class") == c, F.col("recall"))))
    found = s.groupBy("policy").agg(F.sum("support").alias("rows"), r6(F.avg("f1")).alias("macro_f1"), recall("FALLING").alias("falling_recall"), recall("RISING").alias("rising_recall"))
    return found.withColumn("retention", r6(F.col("rows") / F.max("rows").over(Window.partitionBy(F.lit(1)))))  # a row for each policy


ASSESSED = f"""(SELECT event_id, fold FROM (SELECT event_id, i, n, unnest([1, 2, 3]) AS fold FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT * EXCLUDE (i, n) FROM ({SPLIT}) WHERE split = 'train')))
WHERE i >= n * fold // 4 AND i < n * (fold + 1) // 4)"""
CHOICES = f"(SELECT fold, 'H' || h AS candidate, a.label, b.label AS guess FROM ({_slopes_sql(3)}) a JOIN (SELECT 2 AS h, * FROM ({_slopes_sql(2)}) UNION ALL SELECT 5, * FROM ({_slopes_sql(5)})) b USING (event_id) JOIN {ASSESSED} USING (event_id))"


@query(f"WITH s AS (SELECT candidate, fold, avg(f1) AS f FROM {f1_sql(CHOICES, 'candidate, fold', TREND)} GROUP BY ALL), m AS (SELECT candidate, avg(f) AS score FROM s GROUP BY candidate) SELECT candidate, round(score, 6) AS score, score = (SELECT max(score) FROM m) AS chosen FROM m")
def m22_selection(spark, d):
    """Candidates scored on chronological folds of the train rows alone; the best is chosen."""
    train = splits.chronological_split(table(spark, d, "events"), "user_id", 0).where("split = 'train'").select("user_id", "event_id", "ts")
    assessed = splits.inner_folds(train, "user_id", 3, DAY).where("role = 'assess'").select("event_id", "fold")
    guesses = _slopes(spark, d, 2).withColumn("candidate", F.lit("H2")).unionByName(_slopes(spark, d, 5).withColumn("candidate", F.lit("H5"))).select("event_id", "candidate", F.col("label").alias("guess"))
    rows = _slopes(spark, d, 3).select("event_id", "label").join(guesses, "event_id").join(assessed, "event_id")
    m = evaluation.macro_f1(rows, ["candidate", "fold"], "label", "guess", TREND).groupBy("candidate").agg(F.avg("macro_f1").alias("score"))
    return m.select("candidate", r6("score").alias("score"), (F.col("score") == F.max("score").over(Window.partitionBy(F.lit(1)))).alias("chosen"))  # a row for each candidate


VARIANTS = f"(SELECT h, k, v.label, CASE WHEN b.slope < -k THEN 'FALLING' WHEN b.slope > k THEN 'RISING' ELSE 'STABLE' END AS guess FROM ({_slopes_sql(3)}) v JOIN (SELECT 2 AS h, * FROM ({_slopes_sql(2)}) UNION ALL SELECT 3, * FROM ({_slopes_sql(3)}) UNION ALL SELECT 5, * FROM ({_slopes_sql(5)})) b USING (event_id) CROSS JOIN (SELECT unnest([10, 20, 40]) AS k))"


@query(f"SELECT h, k, round(avg(f1), 6) AS macro_f1, sum(support)::BIGINT AS n FROM {f1_sql(VARIANTS, 'h, k', TREND)} GROUP BY h, k")
def m23_variant_matrix(spark, d):
    """Nine variants, three ranges by three thresholds, in one grouped pass."""
    guesses = None
    for h in (2, 3, 5):
        own = _slopes(spark, d, h).select("event_id", F.col("slope").alias("other"), F.lit(h).alias("h"))
        guesses = own if guesses is None else guesses.unionByName(own)
    rows = _slopes(spark, d, 3).select("event_id", "label").join(guesses, "event_id").withColumn("k", F.explode(F.array(*map(F.lit, (10, 20, 40)))))
    other, k = F.col("other"), F.col("k")
    rows = rows.withColumn("guess", F.when(other < -k, "FALLING").when(other > k, "RISING").otherwise("STABLE"))
    s = evaluation.class_scores(rows, ["h", "k"], "label", "guess", TREND)
    return s.groupBy("h", "k").agg(r6(F.avg("f1")).alias("macro_f1"), F.sum("support").alias("n"))


SWEEP = "(SELECT cut, CASE WHEN n_chars >= cut THEN 'LONG' ELSE 'SHORT' END AS label, CASE WHEN quality = 1 THEN 'LONG' ELSE 'SHORT' END AS guess FROM documents JOIN labels USING (doc_id) CROSS JOIN (SELECT unnest([200, 400, 800, 1600]) AS cut))"


@query(f"WITH s AS (SELECT cut, avg(f1) AS f, min(support) AS least FROM {f1_sql(SWEEP, 'cut', ['LONG', 'SHORT'])} GROUP BY cut) SELECT cut, least, round(f, 6) AS macro_f1, CASE WHEN least >= 20 AND f >= 0.55 THEN 'VIABLE' ELSE 'NOT_VIABLE' END AS verdict FROM s")
def m24_candidate_sweep(spark, d):
    """Each way to bin the reference, its least support and how well the other label tells it, with a verdict."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id").withColumn("cut", F.explode(F.array(*map(F.lit, (200, 400, 800, 1600)))))
    name = lambda c: F.when(c, "LONG").otherwise("SHORT")
    s = evaluation.class_scores(rows.select("cut", name(F.col("n_chars") >= F.col("cut")).alias("label"), name(F.col("quality") == 1).alias("guess")), ["cut"], "label", "guess", ["LONG", "SHORT"])
    m = s.groupBy("cut").agg(F.avg("f1").alias("f"), F.min("support").alias("least"))
    return m.select("cut", "least", r6("f").alias("macro_f1"), verdict(F.col("f") - 0.5, F.col("least")).alias("verdict"))


def verdict(gain: Column, least: Column) -> Column:
    """A candidate is viable if it gains .05 on the constant and every class has 20 cases."""
    return F.when((least >= 20) & (gain >= 0.05), "VIABLE").otherwise("NOT_VIABLE")


@query(f"""WITH u AS (SELECT user_id, avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view') AS delta FROM events GROUP BY user_id), c AS (SELECT avg(delta) - 1.96 * stddev_samp(delta) / sqrt(count(delta)) AS low FROM u),
s AS (SELECT max(recall) FILTER (class = 'FALLING') AS f, max(recall) FILTER (class = 'RISING') AS r FROM {f1_sql(PAIRS, '', TREND)})
SELECT round(low, 6) AS ci_lower, round(f, 6) AS falling_recall, round(r, 6) AS rising_recall, CASE WHEN low <= 0 OR f <= 0 OR r <= 0 THEN 'not_supported' ELSE 'supported' END AS decision FROM c CROSS JOIN s""")
def m25_decision(spark, d):
    """Go only if the difference's lower bound is above zero and both directions are ever found."""
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    u = table(spark, d, "events").groupBy("user_id").agg((of("click") - of("view")).alias("delta"))
    c = u.agg((F.avg("delta") - 1.96 * F.stddev_samp("delta") / F.sqrt(F.count("delta"))).alias("low")).withColumn("k", F.lit(1))
    recall = lambda x: F.max(F.when(F.col("class") == x, F.col("recall")))
    s = evaluation.class_scores(pairs(spark, d), [], "label", "guess", TREND).agg(recall("FALLING").alias("f"), recall("RISING").alias("r")).withColumn("k", F.lit(1))
    bad = (F.col("low") <= 0) | (F.col("f") <= 0) | (F.col("r") <= 0)
    return c.join(s, "k").select(r6("low").alias("ci_lower"), r6("f").alias("falling_recall"), r6("r").alias("rising_recall"), F.when(bad, "not_supported").otherwise("supported").alias("decision"))


