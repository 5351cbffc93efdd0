"""Importance resampling of documents towards a target, by hashed features.

Each document's features (runs of words) are counted by hash bucket. The sparse document-by-bucket matrix is written
once as CSR blocks: rows of Parquet that hold the ids of up to 1,024 documents, where each one's entries begin, and the
entries' buckets and counts; a block is closed early once it has 2^18 entries, so blocks are bounded whatever the texts.
Row groups of these tables are bounded too, as a task that reads blocks holds a row group of them.
Column sums over the blocks give the two distributions, from them come the gains of the buckets, and a sparse
matrix-vector product with the gains gives every document's weight. Only vectors of the buckets' size reach the driver
and the tasks. Scores add noise that a digest of doc_id decides, so the draw is one without replacement in proportion
to the weights, the same on every run.

The best scores are found in two steps: a count of documents by score, whose values are bounded (some 10^5), tells the
score beyond which nothing is drawn; the rest, little more than is drawn, is dealt into sorted ranges and ranked there.

Edge cases: a null text has no words and no features, weight 0; a null doc_id is the empty string to the digest and
ranks last among equal scores; rows that repeat a doc_id are documents of their own, in no given order; an empty
target or an empty table counts as no features, and an empty table gives no rows. A text is read whole, a megabyte of
its words at a time; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import release, stored

BUCKETS, WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
BLOCK_ROWS, BLOCK_ENTRIES, PART, MOST_KNOWN = 1024, 1 << 18, 1 << 20, 1 << 18
GROUP_BYTES = 8 << 20  # of a row group of blocks; a task holds few of them at once, however long its file
BLOCK = "ids array<bigint>, begins array<bigint>, buckets array<int>, counts array<bigint>, words array<bigint>"
#: Lower-cases A-Z and turns what is no word, among ASCII, into blanks; bytes of other characters stay.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Known(dict):
    """The bucket of a feature, worked out once while it is remembered."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MOST_KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some PART bytes at a time."""
    plain, at = text.translate(PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + PART)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _counted(text: bytes, words: int, buckets: int, known: _Known) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets met, their counts, and the number of words of a text; features are runs of 1 to `words` words."""
    found, n, tail = [], 0, []
    for part in _parts(text):
        n += len(part)
        seen = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
        joined = tail + part
        for k in range(2, words + 1):
            begin = max(0, len(tail) - k + 1)
            longer = [known[b" ".join(joined[i : i + k])] for i in range(begin, len(joined) - k + 1)]
            seen = np.concatenate([seen, np.array(longer, np.int64)])
        tail = joined[-(words - 1) :] if words > 1 else []
        found.append(np.unique(seen, return_counts=True))
    if len(found) == 1:
        return *found[0], n
    total = np.zeros(buckets, np.int64)
    for at, count in found:
        total[at] += count
    at = np.flatnonzero(total)
    return at, total[at], n


def csr_blocks(rows: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """rows (id, text) as CSR blocks; `words` of a block has the number of words of each document."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(buckets)
        ids, lengths, at, counts, words_of = [], [], [], [], []

        def block() -> pa.RecordBatch:
            begins = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            flat = lambda x, kind: np.concatenate([np.empty(0, kind), *x]).astype(kind)
            found = [one(ids, pa.int64()), one(begins, pa.int64()), one(flat(at, np.int32), pa.int32()), one(flat(counts, np.int64), pa.int64()), one(words_of, pa.int64())]
            for kept in (ids, lengths, at, counts, words_of):
                kept.clear()
            return pa.RecordBatch.from_arrays(found, ["ids", "begins", "buckets", "counts", "words"])

        entries = 0
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                b, c, n = _counted((text.as_py() or "").encode(), words, buckets, known)
                ids.append(own)
                lengths.append(len(b))
                at.append(b)
                counts.append(c)
                words_of.append(n)
                entries += len(b)
                if len(ids) >= BLOCK_ROWS or entries >= BLOCK_ENTRIES:
                    yield block()
                    entries = 0
        if ids:
            yield block()

    return rows.mapInArrow(blocks, BLOCK)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is met; as many numbers as buckets come to the driver, whatever the rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, counts = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            total += np.bincount(at, weights=counts, minlength=buckets).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    parts = blocks.select("buckets", "counts").mapInArrow(sums, "bucket bigint, n bigint")
    found = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target to that of the source."""
    k, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighed(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, n_words, weight of every document: the floored mean gain of its features."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, begins, at, counts, words = (batch.column(c)[k].values for c in range(5))
                begins, at, counts = (x.to_numpy(zero_copy_only=False) for x in (begins, at, counts))
                upto = lambda x: np.concatenate([[0], np.cumsum(x)])[begins]
                n, total = np.diff(upto(counts)), np.diff(upto(counts * gain[at]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), words, pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], ["doc_id", "n_features", "n_words", "weight"])

    return blocks.select("ids", "begins", "buckets", "counts", "words").mapInArrow(product, "doc_id bigint, n_features bigint, n_words bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel draw g that the digest of seed and doc_id decides."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u)))


def drawn(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """scored with rank: 1, 2, ... of the highest scores among documents of at least `least_words` words, else null.

    `scored` has to give the same rows each time, as a stored table does.
    """
    fit = F.col("n_words") >= least_words
    # Scores are whole numbers of bounded size, so this is a row for each of some 10^5 values at most.
    counts = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    above = counts.select("score", "n", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"))).alias("upto"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = total * percent // 100
    cut = above.where(F.col("upto") - F.col("n") < most).agg(F.min("score")).first()[0]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = fit & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("its_row")]
    rows = scored.where(near).withColumn("its_row", F.monotonically_increasing_id())
    # Written, as the ranges are looked at twice and have to be the same both times.
    dealt = stored(rows.repartitionByRange(*order).withColumn("its_range", F.spark_partition_id()), "drawn")
    sizes = dealt.groupBy("its_range").agg(F.count("*").alias("its_rows"))
    before = F.sum("its_rows").over(Window.partitionBy(F.lit(1)).orderBy("its_range")) - F.col("its_rows")
    inside = F.row_number().over(Window.partitionBy("its_range").orderBy(*order))
    ranked = dealt.withColumn("its_place", inside).join(F.broadcast(sizes.select("its_range", before.alias("its_before"))), "its_range")
    rank = (F.col("its_place") + F.col("its_before")).cast("long")
    ranked = ranked.select(*scored.columns, F.when(rank <= most, rank).alias("rank"))
    return ranked.unionByName(scored.where(~F.coalesce(near, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; target has a column text."""
    text = F.col("text").cast("string").alias("text")
    blocks = stored(csr_blocks(docs.select(F.col("doc_id").cast("long").alias("id"), text), words, buckets), "csr", GROUP_BYTES)
    wanted = csr_blocks(target.select(F.lit(None).cast("long").alias("id"), text), words, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(wanted, buckets))
    scored = weighed(blocks, gain)
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    release(blocks)
    return drawn(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
