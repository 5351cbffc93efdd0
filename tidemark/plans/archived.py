"""Archives and stored streams as queries: tables are written by Spark, read back by range or up to cut-offs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..operators.tables import shared_path, stored
from ..sinks.archives import write_archives
from ..sources import archives, files
from ..sources.streams import StreamLayout
from .catalogue import DAY, query, r6, table


def archived_documents(spark, d, named):
    """The documents as members of ZIP archives, a name to each; the inventory of the archives."""
    folder = shared_path(spark, "archives")
    write_archives(table(spark, d, "documents").select(named.alias("member"), "text"), folder, "member", "text")
    return files.inventory(spark, folder)


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS found, true AS intact FROM documents")
def s13_archive_members(spark, d):
    """All documents, archived and read back member by member."""
    found = archives.archive_members(archived_documents(spark, d, F.concat(F.lit("texts/"), F.col("doc_id"), F.lit(".txt"))))
    return found.select(F.regexp_extract("member", r"(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "bytes", "found", "intact")


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlisted' WHEN d.doc_id IS NULL THEN 'missing' WHEN d.lang = 'fr' THEN 'differs' ELSE 'ok' END AS state
FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN documents d USING (doc_id)""")
def j15_match_members(spark, d):
    """Archived documents against a manifest that lists the labelled ones, with another digest for the French."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    path = F.concat(F.lit("texts/"), F.col("doc_id"), F.lit(".txt"))
    members = archives.archive_members(archived_documents(spark, d, F.concat(F.lit("root/"), path)))
    labels = table(spark, d, "labels").select("doc_id").distinct()
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("lang") == "fr", "!").otherwise(""))
    manifest = labels.join(docs, "doc_id", "left").select(path.alias("name"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"), F.lit(True).alias("valid"))
    matched = archives.match_members(stored(members, "members"), manifest)
    return matched.select(F.regexp_extract(F.coalesce("name", "member"), r"(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "state")


FIRST = "(SELECT user_id, min(ts) AS stop_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)"


@query(f"SELECT user_id, count(*) AS n, max(epoch_us(ts)) AS last_at, round(avg(value), 6) AS mean FROM events JOIN {FIRST} USING (user_id) WHERE ts <= stop_at GROUP BY user_id")
def s02_read_until(spark, d):
    """Streams stored by time and read up to each one's first purchase; folders behind the cut-offs are not read."""
    e = table(spark, d, "events")
    layout, path = StreamLayout("user_id", "ts", bins=4, width=3 * DAY), shared_path(spark, "streams")
    layout.write(e.select("user_id", "ts", "value"), path)
    stops = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("stop_at"))
    rows = layout.read_until(spark, path, stops)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max(ts.micros("ts")).alias("last_at"), r6(F.avg("value")).alias("mean"))
