"""Files as queries: tables leave by the sinks, as CSV, Parquet, reports or archives, and come back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tables import shared_path, stored
from ..sinks import writers
from ..sinks.archives import write_archives
from ..sources import archives, files
from ..streaming.spans import span_stream
from .catalogue import HOUR, SPANS, query, r6, table

OWNER = r"participant=([^/]+)/"
SECOND = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {})"


def owned_csv(spark, rows, name):
    """rows (with participant) as CSV files in a folder for each participant; the folders as one path."""
    folder = shared_path(spark, name)
    writers.write_csv(rows, folder, partition_by=["participant"])
    return f"{folder}/*"


def waveform_csv(spark, d):
    """Vectors as a signal at 64 Hz: each is a second of one of sixteen participants."""
    samples = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    at = F.expr(SECOND.format("cast(vec_id div 16 + i / 64.0 as decimal(18, 6))"))
    return owned_csv(spark, samples.select((F.col("vec_id") % 16).alias("participant"), at.cast("string").alias("datetime"), F.col("v").cast("double").alias("bvp")), "waveform")


SIGNAL = "datetime timestamp_ntz, bvp double"
SAMPLES = """SELECT vec_id, (vec_id % 16)::VARCHAR AS participant, vec_id // 16 AS second, (vec_id // 16) * 1000000 + (generate_subscripts(embedding, 1) - 1) * 15625 AS t, unnest(embedding)::DOUBLE AS v
FROM embeddings WHERE vec_id IS NOT NULL"""


@query(f"""SELECT participant, count(*) AS n, count_if(v IS NOT NULL AND isfinite(v)) AS n_finite, count_if(gap = 0) AS duplicates, count_if(gap > 20000) AS gaps, max(gap) AS max_gap
FROM (SELECT *, t - lag(t) OVER (PARTITION BY participant ORDER BY t) AS gap FROM ({SAMPLES})) GROUP BY participant""")
def s01_signal_csv(spark, d):
    """A signal read under its header's contract and audited by participant."""
    return files.audited_signal(files.read_signal_csv(spark, waveform_csv(spark, d), SIGNAL, OWNER), 20_000, "datetime", "bvp")


@query(f"SELECT participant, second, count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high FROM ({SAMPLES}) GROUP BY participant, second")
def s06_waveform_seconds(spark, d):
    """The waveform of each participant by seconds."""
    second = F.unix_seconds(F.date_trunc("second", F.col("datetime").cast("timestamp"))) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    rows = files.read_signal_csv(spark, waveform_csv(spark, d), SIGNAL, OWNER).groupBy("participant", second.alias("second"))
    return rows.agg(F.count("*").alias("n"), r6(F.avg("bvp")).alias("mean"), r6(F.min("bvp")).alias("low"), r6(F.max("bvp")).alias("high"))


@query("""WITH e AS (SELECT coalesce(source, 'none') AS participant, CASE WHEN doc_id % 7 <> 3 THEN doc_id // 2 END AS minute, CASE WHEN doc_id % 5 <> 2 THEN n_chars END AS chars FROM documents WHERE lang = 'en'),
k AS (SELECT participant, minute, min(chars) AS chars, count(*) AS c FROM e WHERE minute IS NOT NULL AND chars IS NOT NULL GROUP BY participant, minute),
n AS (SELECT participant, count(*) AS n, count_if(minute IS NULL) AS bad_time, count_if(chars IS NULL) AS bad_chars FROM e GROUP BY participant),
a AS (SELECT participant, sum(c - 1)::BIGINT AS duplicates FROM k GROUP BY participant)
SELECT participant, minute, chars, n, bad_time, bad_chars, duplicates FROM k JOIN n USING (participant) JOIN a USING (participant)""")
def s04_event_log(spark, d):
    """Documents as an event log in which times and values don't parse: the clean English rows with what was left out."""
    columns = {"Timestamp (YYYY-MM-DDThh:mm:ss)": "at timestamp_ntz", "Value (chars)": "chars bigint"}
    time, value = columns
    at = F.date_format(F.expr(SECOND.format("cast((doc_id div 2) * 60 as decimal(18, 6))")), "yyyy-MM-dd'T'HH:mm:ss")
    log = table(spark, d, "documents").select(
        F.coalesce("source", F.lit("none")).alias("participant"),
        F.col("lang").alias("Event Type"),
        F.when(F.col("doc_id") % 7 == 3, "unknown").otherwise(at).alias(time),
        F.when(F.col("doc_id") % 5 == 2, "Low").otherwise(F.col("n_chars").cast("string")).alias(value),
    )
    clean, counts = files.read_event_log(spark, owned_csv(spark, log, "events"), "en", columns, "Event Type", OWNER)
    minute = F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', at)")
    return clean.join(counts, "participant").select("participant", minute.alias("minute"), "chars", "n", "bad_time", "bad_chars", "duplicates")


@query("""SELECT (vec_id % 16)::VARCHAR AS participant, vec_id // 16 AS second, CASE WHEN vec_id % 11 = 0 THEN 0
ELSE round(sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2), 6) END AS magnitude FROM embeddings""")
def s05_motion_csv(spark, d):
    """Three components of each vector as motion, of which some lack an axis, joined to all seconds; those have 0."""
    axes = ["acc_x", "acc_y", "acc_z"]
    v = table(spark, d, "embeddings")
    second, owner = F.expr("vec_id div 16"), (F.col("vec_id") % 16).cast("string")
    part = lambda k: F.get("embedding", F.lit(k)).cast("double")
    rows = v.select(
        owner.alias("participant"), F.expr(SECOND.format("cast(vec_id div 16 as decimal(18, 6))")).cast("string").alias("datetime"),
        part(0).alias(axes[0]), F.when(F.col("vec_id") % 11 != 0, part(1)).alias(axes[1]), part(2).alias(axes[2]), F.lit("more").alias("further"),
    )
    motion = files.read_motion_csv(spark, owned_csv(spark, rows, "motion"), axes, participant=OWNER)
    read = F.unix_seconds(F.col("datetime").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    size = F.sqrt(sum((F.col(a) * F.col(a) for a in axes), F.lit(0.0)))
    motion = motion.select("participant", read.alias("second"), r6(size).alias("magnitude"))
    return files.with_motion(v.select(owner.alias("participant"), second.alias("second")), motion, ["participant", "second"], "magnitude")


@query("SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS digest FROM documents")
def k01_csv_results(spark, d):
    """Results by document, written as CSV with a header and read back."""
    path = shared_path(spark, "results")
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    writers.write_csv(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", digest.alias("digest")), path)
    return spark.read.schema("doc_id long, lang string, source string, n_chars long, digest string").option("header", True).option("enforceSchema", False).csv(path)


@query("SELECT doc_id, lang, length(text) AS chars FROM documents WHERE lang IN ('de', 'fr') AND n_chars >= 200")
def k02_parquet_results(spark, d):
    """Documents written by language and read back: two folders, and of these the row groups with long texts."""
    path = shared_path(spark, "by-language")
    writers.write_parquet(table(spark, d, "documents").select("doc_id", "n_chars", F.length("text").alias("chars"), "lang"), path, ["lang"])
    return spark.read.parquet(path).where(F.col("lang").isin("de", "fr") & (F.col("n_chars") >= 200)).select("doc_id", "lang", F.col("chars").cast("long").alias("chars"))


GROUPS = "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL"


def label_groups(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(f"SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, n, CASE WHEN toxic = 0 THEN n::DOUBLE END AS finite FROM ({GROUPS})")
def k03_json_report(spark, d):
    """Counts of labels as a JSON report, where what is not finite is null, and read back."""
    path = f"{shared_path(spark, 'report')}.json"
    finite = F.when(F.col("toxic") == 0, F.col("n").cast("double")).otherwise(float("inf"))
    writers.write_json({"groups": writers.few(label_groups(spark, d).withColumn("finite", finite), 100)}, path)
    schema = "groups array<struct<quality: long, toxic: long, n: long, finite: double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("groups").alias("g")).select("g.*")


@query(f"SELECT quality::VARCHAR AS quality, toxic::VARCHAR AS toxic, n FROM ({GROUPS})")
def k04_markdown_report(spark, d):
    """The same counts as a table of a Markdown report, and its cells read back."""
    path = f"{shared_path(spark, 'report')}.md"
    writers.write_markdown("Labels", {"About": "Counts by label.", "Groups": label_groups(spark, d)}, path)
    cells = F.split("value", r"\s*\|\s*")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\|.*\d"))
    return rows.select(cells[1].alias("quality"), cells[2].alias("toxic"), cells[3].cast("long").alias("n"))


@query("SELECT *, true AS built_first, false AS built_again FROM labels")
def k07_restored_labels(spark, d):
    """Labels built where they are missing, held to a fingerprint, and not built again."""
    labels, path = table(spark, d, "labels"), shared_path(spark, "restored")
    expected = writers.fingerprint(labels)
    built = [writers.restore_if_missing(spark, path, expected, lambda: labels) for _ in range(2)]
    return spark.read.parquet(path).withColumns({"built_first": F.lit(built[0]), "built_again": F.lit(built[1])})


@query("""WITH b AS (SELECT DISTINCT doc_id // 500 AS b FROM documents WHERE doc_id IS NOT NULL)
SELECT 'part/' || b || '.txt' AS name, CASE WHEN b % 7 = 2 THEN 'unlisted' WHEN b % 5 = 1 THEN 'differs' WHEN b % 11 = 3 THEN 'invalid' ELSE 'ok' END AS state FROM b
UNION ALL SELECT 'part/gone-' || b || '.txt', 'missing' FROM b WHERE b % 6 = 0""")
def v11_verified_files(spark, d):
    """Digests of texts, five hundred ids to a file: archived, extracted under a manifest, and held to another one with
    planted faults. Ids of one file are a bounded group, as doc_id is a key."""
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.expr("doc_id div 500").alias("b"), F.struct("doc_id", digest.alias("digest")).alias("row"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["digest"]), "\n")
    parts = stored(docs.groupBy("b").agg(lines.alias("text")).withColumn("name", F.concat(F.lit("part/"), F.col("b"), F.lit(".txt"))), "parts")
    held, folder, out = (shared_path(spark, n) for n in ("archives", "manifests", "extracted"))
    write_archives(parts, held, "name", "text")
    own = F.sha2(F.encode("text", "UTF-8"), 256)
    entry = lambda value, name: F.concat_ws("  ", value, name).alias("value")
    parts.select(entry(own, F.col("name"))).write.text(f"{folder}/own")
    archives.extract_verified(files.inventory(spark, held), files.read_manifest(spark, f"{folder}/own"), out).write.format("noop").mode("overwrite").save()
    planted = F.when(F.col("b") % 5 == 1, F.sha2(F.encode(F.concat("text", F.lit("!")), "UTF-8"), 256)).when(F.col("b") % 11 == 3, F.upper(F.concat(own, F.lit("x")))).otherwise(own)
    wrong = parts.where("b % 7 <> 2").select(entry(planted, F.col("name")))
    gone = parts.where("b % 6 = 0").select(entry(own, F.concat(F.lit("part/gone-"), F.col("b"), F.lit(".txt"))))
    wrong.union(gone).write.text(f"{folder}/planted")
    return files.verify_files(spark, files.read_manifest(spark, f"{folder}/planted"), out, depth=2)


@query(SPANS)
def r01_stream_spans(spark, d):
    """Spans of a stream that is stopped and resumed: halves of the events arrive in turn, state stays in the checkpoint,
    and a last row far behind closes what is open. Equal to the spans of all rows."""
    e = table(spark, d, "events").select("user_id", "ts")
    source, kept, out = (shared_path(spark, n) for n in ("stream", "state", "spans"))
    e = e.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    middle = e.agg(F.expr("timestampadd(SECOND, timestampdiff(SECOND, min(ts), max(ts)) div 2, min(ts))").alias("m")).first()["m"]
    m = F.lit(str(middle)).cast("timestamp_ntz")
    last = spark.range(1).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit("2100-01-01").cast("timestamp_ntz").alias("ts"))
    for k, part in enumerate((e.where(F.col("ts") < m), e.where(F.col("ts") >= m), last)):
        part.write.parquet(f"{source}/part={k}")
        stream = spark.readStream.schema(e.schema).parquet(f"{source}/*")
        run = span_stream(stream, "user_id", 12 * HOUR).writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(out)
        run.awaitTermination()
    return spark.read.schema(f"user_id {e.schema['user_id'].dataType.simpleString()}, span_start long, span_end long, n_rows long").parquet(out).where("user_id >= 0")
