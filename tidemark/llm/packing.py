"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

Each document is encoded and ends with an end id. A longer one than a sequence is cut into full pieces; only its
first piece may be shorter. What is to be packed is thus one piece a document of 1 to `size` tokens. Best-fit
decreasing runs over the counts per length (at most `size` of them), not over documents, and yields a small plan:
"items number a to b of length L stand one behind the other, k to a sequence, in sequences s, s+1, ... from offset o".
It opens as many sequences as best-fit decreasing over single items, and leaves the same room in them. Documents take
their slots by a join on their rank within the length. Ranks are distributed: within (length, salt) by a window, plus
the counts of the lower salts; the salts grow with the number of pieces, so that a length that most documents share is
still ranked in many tasks. A full piece fills a sequence alone and needs no rank.

Edge cases: null and empty texts are one piece with the end id; texts of any length are cut whole; rows that share a
doc_id, equal ones too, and rows with a null doc_id are packed separately; an empty table gives no rows; other
columns, of whatever name, are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .storage import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ticket long"
RUN = 1_000_000  # pieces of one salt


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """One row per piece of each document, with the crc32 of its ids and a number of its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        ticket = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(text) + end
                n = len(ids) // 4
                bounds = [0, *range((n - 1) % size + 1, n + 1, size)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ticket + k) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
                ticket += len(bounds) - 1
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ticket"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, items, items a sequence, first sequence, offset).

    Of several items of one length, best fit puts each on top of the last one until the sequence has no room for
    another, as no other sequence has less room that is enough. So the sequences with the least sufficient room take
    as many items each as fit, and the last of them those that are left. Open sequences are kept as runs of
    consecutive ids with the same room; a length splits at most one run, so the plan has a few rows per length,
    however many documents there are.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, how many)]
    rooms: list[int] = []
    out, sequences = [], 0

    def open_run(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room, first, many = size, sequences, -(-left // (size // length))
                sequences += many
            each = room // length
            whole = min(many, left // each)
            rest = left - whole * each if whole < many else 0
            if whole:
                out.append((length, rank, whole * each, each, first, size - room))
                open_run(room - each * length, first, whole)
            if rest:
                out.append((length, rank + whole * each, rest, rest, first + whole, size - room))
                open_run(room - rest * length, first + whole, 1)
            open_run(room, first + whole + (rest > 0), many - whole - (rest > 0))
            rank += whole * each + rest
            left -= whole * each + rest
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer, end_id, size), "pieces")
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full, short = pieces.where(F.col("length") == size), pieces.where(F.col("length") < size)
    lengths = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(lengths, size)
    used = max((first - (-items // each) for _, _, items, each, first, _ in rows), default=0)
    salts = 64 + sum(lengths.values()) // RUN
    salted = short.withColumn("salt", F.pmod(F.xxhash64("ticket"), F.lit(salts)))
    # At most size * salts rows: a row for each thousand pieces or so, whatever their number.
    counts = salted.groupBy("length", "salt").count()
    below = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("base"))
    slots = spark.createDataFrame(rows, "slot_length long, first_rank long, items long, each long, first_sequence long, slot_offset long")
    ranked = salted.withColumn("inside", F.row_number().over(Window.partitionBy("length", "salt").orderBy("ticket")) - 1)
    ranked = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("inside"))
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("items"))
    place = F.col("rank") - F.col("first_rank")
    sequence, offset = F.col("first_sequence") + F.floor(place / F.col("each")), F.col("slot_offset") + place % F.col("each") * F.col("length")
    packed = ranked.join(F.broadcast(slots), fits).select(*own, sequence.alias("sequence_id"), offset.alias("offset"))
    return packed.unionByName(full.select(*own, (F.lit(used) + F.col("ticket")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
