"""Exact Jaccard join on word n-gram sets by a prefix-tree join.

1. One pass turns each text into its set of n-gram hashes. Texts with the same set form a class; from here on the
   join works on classes, so exact copies cost nothing. A class is told by two 64-bit hashes of its set.
2. N-grams that many documents hold are counted per task and summed; the 2^18 commonest go last in the global order,
   by their counts. Within it each n-gram is a number, so that sets, prefixes and tries are plain sorted numbers. Two
   sets of the wanted similarity share a gram within their prefixes (the first n - ceil(t n) + 1 grams in that order).
3. Prefix grams that only one class has are dropped. Star rounds then link each class of a gram to one anchor of it,
   which turns a large group of near copies into as many candidate pairs as it has members, not their square.
4. What star rounds have not joined is settled exactly: every pair of classes that share prefix grams and lie in
   different components is a candidate, if it shares as many of them as the similarity demands. Rows of this join
   are kept only if the places of the gram in both sets leave room for the overlap that is needed; grams ahead of it
   that no other prefix has don't count, so a copy with many words of its own meets few of its family. A parity bitmap of
   each whole set then bounds from below in how many grams the two differ, which turns away the pairs of a family
   that lie under the limit before the join makes a row of them.
5. Candidates are verified exactly. The sets compared with one anchor form a trie over the global order; it is walked
   once, partial overlaps are shared along the common paths, and subtrees are pruned by remaining-length bounds.
   An anchor with many candidates is split into chunks of bounded size.

Hot keys: a gram of very many classes is one of the common ones, so what is found out about it (its anchor, its
roots) is a row of a broadcast table of at most 2^18, and its rows are dealt among tasks; joins on a class or a
component deal the rows of a large one among tasks.

Edge cases: null and empty texts, or texts without a word, have an empty set and link with nothing; a text of fewer
words than n is one gram; texts of any length are taken whole; rows that share a doc_id, equal ones too, are separate
documents with one id; a null doc_id counts as the largest; an empty table gives no rows; other columns, of whatever
name, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import filter_of
from .components import connected_components
from .encoding import forget
from .spread import SALTS, spread_join
from .storage import release, stored

BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK = 256  # candidates of one trie
HOT = 1000  # classes of a gram whose rows are dealt among tasks
PAIRED = 1024  # classes of one gram that one task of the last join takes
FIRST_COMMON = 1 << 62  # n-grams are numbers below, common ones in their order from here on
SETS = "doc_id long, cid long, other long, n long, grams array<long>, bits array<long>, common array<long>, counts array<long>"
WORDS = 8  # longs of a parity bitmap


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct 62-bit hashes of each text's word n-grams."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower: A-Z only
    flat = np.frombuffer(b"\n".join([b"", *data, b""]), dtype=np.uint8)
    gap = (flat == 32) | ((flat >= 9) & (flat <= 13))
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    # A word's hash is a polynomial in its bytes, read off running sums over the whole block.
    sums = np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(flat)))
    word = mix((sums[end - 1] - sums[start - 1]) * powers(INVERSE, len(flat))[start])
    first = np.searchsorted(start, np.cumsum([1, *(len(d) + 1 for d in data)]))
    n = max(0, len(word) - words + 1)
    gram = np.full(n, np.uint64(words), dtype=np.uint64)
    for k in range(words):
        gram = mix(gram + word[k : k + n] * np.uint64(2 * k + 3))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1] >> np.uint64(2)).view(np.int64))
        else:
            short = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                short = mix(short + word[k])
            out.append((short >> np.uint64(2)).view(np.int64)[: b - a])
    return out


def parities(grams: np.ndarray) -> np.ndarray:
    """A bitmap whose bits tell whether an odd number of grams fall on each: two sets differ in no fewer grams than
    their bitmaps differ in bits."""
    odd = np.bincount(grams & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def class_of(grams: np.ndarray, seed: int = 0) -> int | None:
    """A hash of the set, or None if it is empty."""
    if not len(grams):
        return None
    total = mix(grams.view(np.uint64) ^ mix(np.array([seed], np.uint64))).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mix(np.array([total]))[0].astype(np.int64))


def sets_of(docs: DataFrame, words: int, often: int = 2) -> DataFrame:
    """A row per document with its class and size, the set itself where the task meets the class first, and a row
    per task with the grams that at least `often` of its classes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[tuple] = set()
        pending: list[np.ndarray] = []
        held, common = 0, defaultdict(int)

        def row(doc: list, cid: list, other: list, n: list, grams: list, extra: tuple | None = None) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 4
            e = extra or ([None] * len(doc), [None] * len(doc))
            bits = [None if g is None else parities(g) for g in grams]
            return pa.record_batch([pa.array(c, k) for c, k in zip((doc, cid, other, n, grams, bits, *e), kinds, strict=True)], ["doc_id", "cid", "other", "n", "grams", "bits", "common", "counts"])

        def tally() -> None:
            if pending:
                u, c = np.unique(np.concatenate(pending), return_counts=True)
                for g, k in zip(u[c >= often].tolist(), c[c >= often].tolist(), strict=True):
                    common[g] += k
                pending.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                sets = gram_sets(part.column(1).to_pylist(), words)
                cids, others, kept = [], [], []
                for s in sets:
                    cid, other = class_of(s), class_of(s, 1)
                    new = cid is not None and (cid, other) not in seen
                    if new:
                        seen.add((cid, other))
                        pending.append(s)
                        held += len(s)
                    cids.append(cid)
                    others.append(other)
                    kept.append(s if new else None)
                yield row(part.column(0).to_pylist(), cids, others, [len(s) for s in sets], kept)
                if held > 4_000_000:
                    tally()
                    held = 0
        tally()
        yield row([None], [None], [None], [None], [None], ([list(common)], [list(common.values())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SETS)


def told_apart(sets: DataFrame) -> DataFrame:
    """sets with another cid for classes that share one by chance: about one pair in 2^64 does, so they may be broadcast."""
    clash = sets.where("cid is not null").groupBy("cid").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high")
    if clash.isEmpty():
        return sets
    clash = F.broadcast(clash.select(F.col("cid").alias("clash")))
    mixed = F.when(F.col("clash").isNotNull(), F.xxhash64("cid", "other")).otherwise(F.col("cid"))
    return sets.join(clash, F.col("cid") == F.col("clash"), "left").withColumn("cid", mixed).drop("clash")


def last_fitting(rows: DataFrame, key: Column, low: int, high: int, room: int, parts: int = 4096) -> tuple[int, int]:
    """(b, room left): the rows with a key over b, of low to high, fit into `room`, those from b on do not."""
    while True:
        width = -(-(high - low + 1) // parts)
        sizes = rows.where(key.between(low, high)).groupBy(F.floor((key - low) / width).alias("part")).count().collect()  # at most `parts` rows
        for r in sorted(sizes, key=lambda r: -r["part"]):
            if r["count"] > room:
                low, high = low + r["part"] * width, min(high, low + (r["part"] + 1) * width - 1)
                break
            room -= r["count"]
        else:
            return low - 1, room
        if low == high:
            return low, room


def common_grams(sets: DataFrame, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The `most` grams that most classes hold and their counts, by ascending count; of those that tie for the last
    places some, by a hash. Only the order of grams depends on them."""
    pairs = sets.where("common is not null").select(F.explode(F.arrays_zip("common", "counts")).alias("p")).select("p.common", "p.counts")
    found = stored(pairs.groupBy("common").agg(F.sum("counts").alias("n")), "common")
    few, top, n, by_hash = found, found.agg(F.max("n")).first()[0], F.col("n"), F.pmod(F.xxhash64("common"), F.lit(1 << 40))
    if found.count() > most:
        least, room = last_fitting(found, n, 1, top, most)
        beyond, _ = last_fitting(found.where(n == least), by_hash, 0, (1 << 40) - 1, room)
        few = found.where((n > least) | ((n == least) & (by_hash > beyond)))
    rows = few.toPandas().sort_values(["n", "common"])
    release(found)
    return rows["common"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


class Order:
    """The global order: each gram as the number of its place."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.by_gram = np.argsort(grams)
        self.grams, self.counts = grams[self.by_gram], counts

    def places(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return grams
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        return np.where(self.grams[at] == grams, FIRST_COMMON + self.by_gram[at], grams)

    def hot(self, places: np.ndarray) -> np.ndarray:
        common = places >= FIRST_COMMON
        out = np.zeros(len(places), dtype=bool)
        out[common] = self.counts[places[common] - FIRST_COMMON] >= HOT
        return out


def prefixes(sets: DataFrame, order: Broadcast, percent: int) -> DataFrame:
    """gram, cid, n, at, hot for each gram of a class's prefix; at is its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), order.value.places(lists.values.to_numpy(zero_copy_only=False))
            out = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                n = b - a
                out.append(np.sort(flat[a:b])[: n - (percent * n + 99) // 100 + 1])
            sizes = [len(p) for p in out]
            cid, n = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
            whole = np.concatenate(out) if out else np.zeros(0, np.int64)
            place = np.arange(len(whole)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) if sizes else whole
            hot = order.value.hot(whole)
            for k in range(0, len(whole), 500_000):
                yield pa.record_batch([pa.array(x[k : k + 500_000]) for x in (whole, cid, n, place, hot)], ["gram", "cid", "n", "at", "hot"])

    return sets.where("grams is not null").select("cid", "n", "grams").mapInArrow(run, "gram long, cid long, n long, at long, hot boolean")


def overlap_needed(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil((na + nb) * percent / (100 + percent) - F.lit(1e-9))


def prefix_overlap_needed(percent: int) -> Column:
    """Grams that the prefixes of a (n `na`) and b (n `nb`) must share: what lies behind a prefix can't add more."""
    rest = lambda n: F.ceil(F.col(n) * percent / 100 - F.lit(1e-9)) - 1
    return F.greatest(F.lit(1), overlap_needed(F.col("na"), F.col("nb"), percent) - F.greatest(rest("na"), rest("nb")))


def room_for_overlap(percent: int) -> Column:
    """Whether a and b that share a gram with `before` shared grams ahead of it and `after` grams behind it can
    reach their overlap: grams ahead of it in one set can't meet grams behind it in the other."""
    most = F.least("before_a", "before_b") + 1 + F.least("after_a", "after_b")
    return most >= overlap_needed(F.col("na"), F.col("nb"), percent)


def few_differences(percent: int) -> Column:
    """Whether a and b differ in no more grams than their overlap allows, as far as their bitmaps tell."""
    apart = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(WORDS)), F.lit(0))
    return F.col("na") + F.col("nb") - 2 * overlap_needed(F.col("na"), F.col("nb"), percent) >= apart


def alike_sizes(percent: int) -> Column:
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def walk_trie(anchor: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Places in sets of those that are similar enough to anchor; all are ascending places of the global order.

    The trie is implied by the sorted order of the sets: a range of them is a subtree, and what its first and last
    set have in common is the path to it.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
    rows, na, found = [sets[i] for i in order], len(anchor), []
    needed = lambda nb: -(-percent * (na + nb) // (100 + percent))

    def shared(part: np.ndarray) -> int:
        at = np.searchsorted(anchor, part)
        at[at == na] = 0
        return int((anchor[at] == part).sum())

    stack = [(0, len(rows), 0, 0)]  # range of sets, depth and overlap of the path
    while stack:
        lo, hi, depth, overlap = stack.pop()
        a, b = rows[lo], rows[hi - 1]
        if hi - lo == 1:
            overlap += shared(a[depth:])
            if overlap >= needed(len(a)):
                found.append(order[lo])
            continue
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:m] != b[depth:m])
        deep = depth + int(differ[0]) if len(differ) else m
        overlap += shared(a[depth:deep])
        sizes = [len(r) for r in rows[lo:hi]]
        left = na - int(np.searchsorted(anchor, a[deep - 1], side="right")) if deep else na
        if overlap + min(left, max(sizes) - deep) < needed(min(sizes)):
            continue  # no set below can reach its overlap
        keys = [int(r[deep]) if len(r) > deep else None for r in rows[lo:hi]]
        cuts = [lo, *(lo + k for k in range(1, hi - lo) if keys[k] != keys[k - 1] or keys[k] is None), hi]
        stack += [(x, y, deep, overlap) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return found


def verified(pairs: DataFrame, sets: DataFrame, order: Broadcast, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; a is the anchor."""
    may_hold = filter_of(pairs.select(F.explode(F.array("a", "b")).alias("cid")), "cid")
    some = sets.where("grams is not null").select("cid", "grams").where(may_hold(F.col("cid")))
    # Candidates of an anchor go into as many chunks as bound them.
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    chunked = stored(spread_join(pairs, sizes, "a", "b").select("a", "b", F.pmod(F.xxhash64("b", "a"), F.col("chunks")).alias("chunk")), "pairs")
    sides = chunked.select("a", "chunk", F.col("b").alias("cid")).union(chunked.select("a", "chunk", F.col("a").alias("cid")).distinct())
    # A class that several tasks met has as many equal sets: first() of a group takes one of them.
    rows = sides.join(some.groupBy("cid").agg(F.first("grams").alias("grams")), "cid")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a = group["a"].iloc[0]
        own = group["cid"] == a
        rest = group[~own]
        ordered = lambda g: np.sort(order.value.places(np.asarray(g)))
        keep = walk_trie(ordered(group["grams"][own].iloc[0]), [ordered(g) for g in rest["grams"]], percent) if len(rest) else []
        return pd.DataFrame({"a": a, "b": rest["cid"].to_numpy()[keep]}).astype("int64")

    found = stored(rows.groupBy("a", "chunk").applyInPandas(compare, "a long, b long"), "links")
    release(chunked)
    return found


def held_prefixes(sets: DataFrame, order: Broadcast, percent: int) -> DataFrame:
    """gram, cid, n, hot, share, before, after: the prefix grams that two classes at least have."""
    # A hot gram is one of many classes, so its rows may lie apart; a class that several tasks met counts once.
    dealt = prefixes(sets, order, percent).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("cid"), F.lit(SALTS))).otherwise(0))
    together = Window.partitionBy("gram", "salt")
    held = dealt.withColumn("low", F.min("cid").over(together)).withColumn("high", F.max("cid").over(together)).where("hot or low <> high")
    held = held.groupBy("gram", "salt", "cid").agg(F.first("n").alias("n"), F.first("at").alias("at"), F.first("hot").alias("hot")).drop("salt")
    # The original of a family shares all its grams; an edited copy has some of its own. A gram ahead of a shared one
    # lies in the prefixes of both or in no overlap, so `before` counts held grams alone. A gram behind it may lie
    # behind the other's prefix and still be in the overlap, so `after` counts every place.
    own = Window.partitionBy("cid")
    held = held.withColumn("share", F.count("*").over(own) / F.col("n")).withColumn("before", F.row_number().over(own.orderBy("at")) - 1)
    return stored(held.withColumn("after", F.col("n") - F.col("at") - 1).drop("at"), "prefixes")


def star_pairs(seats: DataFrame, star: int, percent: int) -> DataFrame:
    """Candidates (a, b): of each component one member in a gram, and one of these is the anchor a of the others:
    first the one that shares most of its grams, later one by chance."""
    first = F.xxhash64("cid", F.lit(star)) if star else -F.col("share")
    member = F.struct(first.alias("key"), "cid", "n")
    # At first each class is a component of its own, and once in a gram.
    each = lambda rows: rows.groupBy("gram", "root").agg(F.min(member).alias("m")) if star else rows.select("gram", "root", member.alias("m"))
    # Rows of a gram that isn't hot are few, so one shuffle serves their components and their anchor.
    cold = each(seats.where("not hot").repartition("gram")).select("gram", "m", F.min("m").over(Window.partitionBy("gram")).alias("anchor"))
    hot = each(seats.where("hot"))  # of at most as many grams as are common
    hot = hot.join(F.broadcast(hot.groupBy("gram").agg(F.min("m").alias("anchor"))), "gram").select("gram", "m", "anchor")
    pairs = cold.union(hot).select(F.col("anchor.cid").alias("a"), F.col("anchor.n").alias("na"), F.col("m.cid").alias("b"), F.col("m.n").alias("nb"))
    pairs = pairs.where(F.col("a") != F.col("b")).where(alike_sizes(percent))
    # Half of the shared grams is enough here: a gram may have had another anchor.
    pairs = pairs.groupBy("a", "b", "na", "nb").count().where(F.col("count") * 2 >= prefix_overlap_needed(percent))
    return stored(pairs.select("a", "b"), "pairs")


def remaining_pairs(seats: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b): all classes of different components that share prefix grams enough."""
    together = Window.partitionBy("gram")
    low, high = F.min("root"), F.max("root")
    cold = seats.where("not hot").withColumn("low", low.over(together)).withColumn("high", high.over(together)).where("low <> high")
    cold = cold.drop("low", "high").withColumn("blocks", F.lit(1).cast("long"))
    hot = seats.where("hot")
    stats = hot.groupBy("gram").agg(low.alias("low"), high.alias("high"), F.ceil(F.count("*") / PAIRED).alias("blocks")).where("low <> high")
    hot = hot.join(F.broadcast(stats.drop("low", "high")), "gram").select(cold.columns)
    # A class that several tasks met has as many equal bitmaps. They grow with the classes, so they are not broadcast.
    bits = sets.where("bits is not null").groupBy("cid").agg(F.first("bits").alias("bits"))
    left = stored(cold.union(hot).drop("share").join(bits.hint("merge"), "cid"), "seats")
    side = lambda rows, x: rows.select("gram", "block", *(F.col(c).alias(f"{c}_{x}") for c in ("root", "before", "after", "bits")), F.col("cid").alias(x), F.col("n").alias(f"n{x}"))
    # Both sides of the first join are one and the same shuffle. Classes of a hot gram are dealt into blocks, and each
    # class meets every block.
    one = left.where("not hot").withColumn("block", F.lit(0).cast("long"))
    near = side(one, "a").drop("block").join(side(one, "b").drop("block"), "gram")
    every, own = (left.where("hot").withColumn("block", c) for c in (F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), F.pmod(F.xxhash64("cid"), F.col("blocks"))))
    far = side(every, "a").join(side(own, "b"), ["gram", "block"])
    apart = lambda rows: rows.where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))).where(alike_sizes(percent) & room_for_overlap(percent) & few_differences(percent)).select("a", "b", "na", "nb")
    pairs = apart(near).union(apart(far)).groupBy("a", "b", "na", "nb").count().where(F.col("count") >= prefix_overlap_needed(percent))
    found = stored(pairs.select("a", "b"), "pairs")
    release(left)
    return found


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, stars: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    written = stored(sets_of(docs, words), "sets")
    sets = told_apart(written)
    order = docs.sparkSession.sparkContext.broadcast(Order(*common_grams(sets)))
    held = held_prefixes(sets, order, percent)
    links, roots = [], None
    for star in range(stars + 1):
        seats = held.withColumn("root", F.col("cid")) if roots is None else rooted(held, roots)
        pairs = star_pairs(seats, star, percent) if star < stars else remaining_pairs(seats, sets, percent)
        new = verified(pairs, sets, order, percent)
        release(pairs)
        if new.isEmpty():
            continue
        links.append(new)
        old, roots = roots, stored(connected_components(reduce(DataFrame.union, links)), "roots")
        if old is not None:
            release(old)
    release(held, *links)
    rows = sets.where("n is not null").select("doc_id", "cid", F.col("n").alias("n_shingles"))
    if roots is None:
        named = stored(rows.select("*", F.col("cid").alias("root")), "named")
    else:
        found = spread_join(rows, roots.select(F.col("node").alias("cid"), F.col("root").alias("found")), "cid", "doc_id", "left")
        named = stored(found.select(*rows.columns, F.coalesce("found", "cid").alias("root")), "named")
        release(roots)
    release(written)
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return spread_join(named, least, "root", "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (with cid) and the root of each class, itself where it has no links."""
    named = rows.join(roots.withColumnRenamed("root", "found"), rows["cid"] == F.col("node"), "left")
    return named.select(*rows.columns, F.coalesce("found", "cid").alias("root"))
