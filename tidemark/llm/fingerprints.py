"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Features are the runs of up to five words that end at each word of a text (four runs at its start are shorter, so that
short texts have features too), lower-cased, words parted by ASCII white space. Each run is hashed once; the hash's high
bits give one of 128 bins, and a bin keeps its least hash. An empty bin takes the value of a bin that is not empty:
the first such in an order of its own, drawn by hashes, that is the same for all texts (optimal densification). The low
eight bits of every bin are packed into sixteen longs. Two fingerprints agree in a bin by chance once in 256, and the
likeness takes this off, so it estimates the Jaccard similarity of the two sets of runs.

The next document is found by one shuffle of the texts: ranges of (doc_id, text's hash) are cut from the keys alone,
a text learns its range by binary search, and the first text of a range goes along to the range before as well. A range
holds a bounded share of the rows, whatever repeats.

Edge cases: a null text is empty. A text without words has no features and the fingerprint ''; two such texts have a
likeness of 1, one such and another of 0. Null doc_ids come first; of one doc_id the text with the smaller hash comes
first, and rows that repeat doc_id and text are one document in this order, each with its row in the result. The next
document of a lone one is itself. Texts are read whole, each within its row. An empty table gives no rows; other
columns, of whatever name, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

WORDS, BINS, BITS = 5, 128, 8
SHIFT = 64 - 7  # a bin is told by the highest seven bits of a hash
FULL = (1 << SHIFT) - 1
PER_LONG = 64 // BITS
RANGE_ROWS, MOST_RANGES, PIECE = 2048, 100_000, 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(text: Column) -> Column:
    """The hash of each run of up to five words, one for each word of the text."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    before = range(WORDS - 1, 0, -1)
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(h, lambda x, i: F.xxhash64(*(F.get(h, i - k) for k in before), x)))


def least_of_bins(hashes: Column) -> Column:
    """The least hash of each bin, in the order of the bins; all low bits are set where a bin is empty."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), SHIFT).bitwiseOR(F.lit(FULL)))
    of = lambda x: F.shiftrightunsigned(x, SHIFT)
    return let(F.sort_array(F.concat(hashes, ends)), lambda s: F.filter(s, lambda x, i: (i == 0) | (of(x) != of(F.get(s, i - 1)))))


def densified(least: Column) -> Column:
    """least_of_bins() with a value in every bin; null if all are empty."""
    empty = lambda x: x.bitwiseAND(F.lit(FULL)) == FULL

    def fill(own: Column, met: Column) -> Column:
        def chosen(i: Column) -> Column:
            # The bin with the least hash of (empty bin, bin); its place among those met stands in the low seven bits.
            drawn = F.transform(met, lambda x, k: F.xxhash64(i, F.shiftrightunsigned(x, SHIFT)).bitwiseAND(F.lit(-BINS)).bitwiseOR(k.cast("long")))
            return F.get(met, F.array_min(drawn).bitwiseAND(F.lit(BINS - 1)).cast("int"))

        return F.when(F.size(met) > 0, F.transform(own, lambda x, i: F.when(empty(x), chosen(i)).otherwise(x)))

    return let(least, lambda own: let(F.filter(own, lambda x: ~empty(x)), lambda met: fill(own, met)))


def packed(values: Column) -> Column:
    """The low bits of all values as longs."""
    low = lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1)))
    part = lambda v, k: F.aggregate(F.slice(v, k * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), low)
    return let(values, lambda v: F.when(v.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda k: part(v, k))))


def fingerprint(text: Column) -> Column:
    """Sixteen longs of packed low-order bits; null for a text without words."""
    return packed(densified(least_of_bins(runs(text))))


def as_hex(print_: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(print_, lambda v: F.lpad(F.hex(v), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two fingerprints, 0 to 1; equal ones have 1."""

    folded = lambda k: lambda v: v.bitwiseOR(F.shiftrightunsigned(v, k))

    def agree(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        for k in (4, 2, 1):  # a byte's lowest bit becomes the union of its bits
            bits = let(bits, folded(k))
        return PER_LONG - F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))

    met = F.aggregate(F.zip_with(a, b, agree), F.lit(0), lambda n, x: n + x)
    chance = 1 / (1 << BITS)
    share = F.greatest(F.lit(0.0), (met / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(share)


def _cuts(keys: DataFrame, rows: int) -> DataFrame:
    """One row: the least key of each range of keys in an array, at most MOST_RANGES of them."""
    ranges = min(MOST_RANGES, 1 + rows // RANGE_ROWS)
    dealt = keys.repartitionByRange(ranges, F.asc_nulls_first("id"), "hash").groupBy(F.spark_partition_id().alias("part"))
    return dealt.agg(F.min(F.struct("id", "hash")).alias("cut")).agg(F.sort_array(F.collect_list("cut")).alias("cuts"))


def _range_of(key: Column, cuts: Column, ranges: int) -> Column:
    """The place of the last cut that is not over the key, by halving."""
    steps = [1 << k for k in reversed(range(max(1, ranges.bit_length())))]
    further = lambda at, step: F.when(F.get(cuts, at + step) <= key, at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, print of each different (doc_id, text) of docs, copies, and next_text, next_print of the document
    after it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = rows.select("id", F.xxhash64("text").alias("hash"))
    cuts = stored(_cuts(keys, docs.count()), "cuts")
    ranges, repeat = cuts.select(F.size("cuts")).first()[0], not keys.groupBy("id", "hash").count().where("count > 1").isEmpty()
    # Rows that repeat are counted first, map-side, so that a hot one is one row of its range.
    rows = rows.groupBy("id", "text").agg(F.count("*").alias("copies")) if repeat else rows.withColumn("copies", F.lit(1).cast("long"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("print", fingerprint(F.col("text")))
    key = F.struct("id", "hash")
    # The one array of cuts, of at most MOST_RANGES keys, is a subquery's value in every task.
    of = lambda c: let(_range_of(key, c, ranges), lambda at: F.struct(at.alias("at"), (F.get(c, at) == key).alias("is_first")))
    met = rows.withColumn("cuts", cuts.scalar()).withColumn("found", let(F.col("cuts"), of)).select("*", "found.at", "found.is_first")
    # A range's first text goes along to the range before; that of the first range to the last, behind all others.
    places = F.array(F.struct(F.col("at").alias("range"), F.lit(0).alias("lent")))
    lent = F.array(F.struct(((F.col("at") + ranges - 1) % ranges).alias("range"), F.when(F.col("at") == 0, 2).otherwise(1).alias("lent")))
    dealt = met.withColumn("place", F.explode(F.when(F.col("is_first"), F.concat(places, lent)).otherwise(places)))
    dealt = dealt.select("id", "hash", "text", "print", "copies", "place.range", "place.lent")
    w = Window.partitionBy("range").orderBy("lent", F.asc_nulls_first("id"), "hash")
    found = dealt.withColumns({"next_text": F.lead("text").over(w), "next_print": F.lead("print").over(w)})
    return found.where("lent = 0").select(F.col("id").alias("doc_id"), "text", "print", "copies", "next_text", "next_print")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last quarter of a text's code points replaced by as many first ones of the next document.
    """
    rows = with_next(docs)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select("doc_id", "copies", "print", "next_print", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_print", fingerprint(F.col("edited")))
    found = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("print")).alias("fingerprint"),
        as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        "copies",
    )
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PIECE))
    own = found.withColumn("piece", F.explode(pieces))
    each = F.array_repeat(F.lit(1), F.least(F.lit(PIECE).cast("long"), F.col("copies") - F.col("piece") * PIECE).cast("int"))
    return own.withColumn("one", F.explode(each)).drop("one", "piece", "copies")
