"""Contracts of tables that can fail: bins that must match once, endpoint labels, provenance of manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_bin(value: Column, bins: list[tuple[object, float | None, float | None]]) -> Column:
    """The name of the only bin [low, high) that holds the value; None leaves an end open.

    A value in no bin or in two fails the query when it is met; null and NaN are in none.
    """
    inside = []
    for name, low, high in bins:
        met = value.isNotNull() & ~F.isnan(value.cast("double"))
        met = met & (value >= low) if low is not None else met
        met = met & (value < high) if high is not None else met
        inside.append(F.when(met, F.lit(name)))
    found = F.array_compact(F.array(*inside))
    told = F.concat(F.lit("bins that hold "), F.coalesce(value.cast("string"), F.lit("null")), F.lit(": "), F.size(found).cast("string"))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.raise_error(told).cast(_kind(bins)))


def _kind(bins: list) -> str:
    return "int" if all(isinstance(b[0], int) for b in bins) else "string"


FAULTS = ["repeated", "unknown", "no_time", "late_history", "thresholds"]


def endpoint_faults(rows: DataFrame, labels: list[str]) -> DataFrame:
    """candidate, n and how many rows break each rule of an endpoint table (candidate, key, at, history_start, label,
    threshold): keys that repeat, labels outside the list (null too), missing times, histories that begin after their
    endpoint, thresholds that are not positive (null too).
    """
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    each = rows.groupBy("candidate", "key").agg(
        F.count("*").alias("k"),
        n(F.col("label").isNull() | ~F.col("label").isin(labels), "unknown"),
        n(F.col("at").isNull() | F.col("history_start").isNull(), "no_time"),
        n(F.col("history_start") > F.col("at"), "late_history"),
        n(F.col("threshold").isNull() | F.isnan("threshold") | (F.col("threshold") <= 0), "thresholds"),
    )
    return each.groupBy("candidate").agg(F.sum("k").alias("n"), F.sum(F.col("k") - 1).alias("repeated"), *(F.sum(c).alias(c) for c in FAULTS[1:]))


def held_endpoints(rows: DataFrame, labels: list[str], primary: str) -> DataFrame:
    """rows, after a check, which runs at once, that no rule of endpoint_faults() is broken and the primary is there."""
    found = endpoint_faults(rows, labels).collect()  # a row for each candidate
    if primary not in {r["candidate"] for r in found}:
        raise ValueError(f"the primary candidate {primary!r} is absent" if found else "the table of endpoints is empty")
    bad = [r.asDict() for r in found if any(r[c] for c in FAULTS)]
    if bad:
        raise ValueError(f"endpoint labels break their contract: {bad}")
    return rows


#: What a frozen manifest has to say of where it comes from, and how each value looks.
PROVENANCE = {"git_commit": r"[0-9a-f]{40}", "git_clean": r"true", "config_sha256": r"[0-9a-f]{64}", "source_sha256": r"[0-9a-f]{64}", "version": r"\S+", "created": r"\d{4}-\d\d-\d\dT\S+"}


def provenance_faults(manifest: dict, wanted: dict[str, str] | None = None) -> list[str]:
    """Sorted codes of what a manifest lacks or states badly: MISSING_<field>, BAD_<field>; digests of files are 64 hex
    digits, and there is at least one."""
    found = []
    for name, looks in (wanted or PROVENANCE).items():
        value = manifest.get(name)
        text = str(value).lower() if isinstance(value, bool) else value
        if value is None or value == "":
            found.append(f"MISSING_{name}")
        elif not isinstance(text, str) or not re.fullmatch(looks, text):
            found.append(f"BAD_{name}")
    files = manifest.get("files")
    if not isinstance(files, dict) or not files:
        found.append("MISSING_files")
    else:
        found += [f"BAD_files:{name}" for name, digest in files.items() if not isinstance(digest, str) or not re.fullmatch(r"[0-9a-f]{64}", digest)]
    return sorted(found)


def held_manifest(manifest: dict) -> dict:
    """The manifest, or an error that names all its faults."""
    if faults := provenance_faults(manifest):
        raise ValueError(f"manifest without provenance: {', '.join(faults)}")
    return manifest
