"""Repair of the turn structure of conversations by a fold in Spark SQL.

Rows of a conversation stand by turn (nulls first), then role, then text. A window marks texts that were said before in
the same role. Rows are collected into chunks of up to 32 turns, sorted, and aggregate() folds each chunk: it carries
four structs of (cost, audit), one for each state of `(s?(ua)+)?`: nothing yet, after s, after u, after a; native least
keeps the cheapest, of equal ones that with the least audit. A chunk is folded from each of the four states, so chunks
are tasks of their own, and a second fold over chunks joins them. In one state and at one cost no audit is the
beginning of another, so the least beginning always belongs to the least whole.

The repaired text of a conversation is one string, as its digest asks: a conversation has to fit a row (2 GB).

Edge cases: a null role or text is one space; a null turn stands first and is left out of gaps; a null conv_id is a
conversation. Rows of one turn, repeated ones too, stand by role and text. A role of another initial than s, u and a
can only be changed or deleted; an empty role has no initial. Where no rows are left all counts are 0. Roles and texts
of any length are compared whole. An empty table gives no rows; other columns, of whatever name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fingerprints import let

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STATES = ["n", "s", "u", "a"]
FAR = 1 << 50  # the cost of a state that can't be reached
CHUNK_BITS = 5  # 32 turns a chunk


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that are left, changed as the digest of conv_id and turn says."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).drop("copy")


def _struct(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(state: Column, cost: Column | int, letter: str) -> Column:
    return _struct(state["cost"] + cost, F.concat(state["audit"], F.lit(letter)))


def _inserted(of: dict[str, Column]) -> Column:
    """The four states after the cheapest insertions: at most two in one place lead anywhere."""
    u = F.least(of["u"], *(_then(of[x], INSERT, "I") for x in "nsa"))
    with_u = let(u, lambda v: F.struct(of["n"].alias("n"), of["s"].alias("s"), v.alias("u"), F.least(of["a"], _then(v, INSERT, "I")).alias("a")))
    return with_u


def _row(acc: Column, row: Column) -> Column:
    """The four states after a row is kept, takes a role or is deleted, and after what is inserted behind it."""
    far = F.lit(FAR)
    dear = F.when(row["truncated"], TRUNCATED).otherwise(0)
    # What may not be done costs too much.
    keep = {x: F.when(row["whole"] & (row["initial"] == x), dear + KEEP).otherwise(far) for x in "sua"}
    rerole = F.when(row["whole"], dear + REROLE).otherwise(far)
    gone = {x: _then(acc[x], DELETE, "D") for x in STATES}
    of = {
        "n": gone["n"],
        "s": F.least(gone["s"], _then(acc["n"], keep["s"], "K")),
        "u": F.least(gone["u"], *(_then(acc[x], keep["u"], "K") for x in "nsa"), *(_then(acc[x], rerole, "R") for x in "nsa")),
        "a": F.least(gone["a"], _then(acc["u"], keep["a"], "K"), _then(acc["u"], rerole, "R")),
    }
    return let(F.struct(*(of[x].alias(x) for x in STATES)), lambda v: _inserted({x: v[x] for x in STATES}))


def _begin(state: str) -> Column:
    return F.struct(*(_struct(F.lit(0 if x == state else FAR), F.lit("")).alias(x) for x in STATES))


def _joined(acc: Column, chunk: Column) -> Column:
    """The four states after a chunk, from the four before it and the chunk's own fold from each of them."""
    via = lambda x, y: _struct(acc[x]["cost"] + chunk[x][y]["cost"], F.concat(acc[x]["audit"], chunk[x][y]["audit"]))
    return F.struct(*(F.least(*(via(x, y) for x in STATES)).alias(y) for y in STATES))


def _turns(rows: Column, audit: Column) -> Column:
    """The repaired `role:text` lines: every row with its letter and the insertions behind it, then roles by place."""
    new = lambda text: F.struct(F.lit(None).cast("string").alias("role"), text.alias("text"))
    blanks = lambda n: F.array_repeat(new(F.lit("")), n)
    first = blanks(F.length(F.regexp_extract(audit, "^I*", 0)))

    def edited(row: Column, letters: Column) -> Column:
        own = F.struct(F.when(letters.startswith("K"), row["role"]).alias("role"), row["text"].alias("text"))
        return F.concat(F.when(letters.startswith("D"), blanks(F.lit(0))).otherwise(F.array(own)), blanks(F.length(letters) - 1))

    pieces = F.flatten(F.concat(F.array(first), F.zip_with(rows, F.regexp_extract_all(audit, F.lit("[DKR]I*"), F.lit(0)), edited)))

    def lines(found: Column) -> Column:
        system = F.coalesce(F.substring(F.get(found, F.lit(0))["role"], 1, 1) == "s", F.lit(False)).cast("int")
        role = lambda x, i: F.coalesce(x["role"], F.when((i - system) % 2 == 0, "user").otherwise("assistant"))
        return F.transform(found, lambda x, i: F.concat(role(x, i), F.lit(":"), x["text"]))

    return let(pieces, lines)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (role:text lines) of each
    conversation in rows (conv_id, turn, role, text, none null but conv_id and turn)."""
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    said = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    blank, last = shown == "", F.substring(shown, -1, 1)
    rows = rows.withColumn("blank", blank).withColumn("again", ~F.col("blank") & (F.row_number().over(said) > 1))
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("again") & ~last.isin(".", "!", "?"))
    turn = F.struct("turn", "role", "text", "again", F.substring("role", 1, 1).alias("initial"), (~F.col("blank") & ~F.col("again")).alias("whole"), "truncated")
    chunk = rows.groupBy("conv_id", F.shiftright("turn", CHUNK_BITS).alias("chunk")).agg(
        F.sort_array(F.collect_list(turn)).alias("rows"), *(F.count_if(c).alias(n) for n, c in (("blank", F.col("blank")), ("duplicate", F.col("again")), ("truncated", F.col("truncated"))))
    )
    folds = F.struct(*(F.aggregate("rows", _begin(x), _row).alias(x) for x in STATES))
    turns = F.transform("rows", lambda r: r["turn"])
    chunk = chunk.select("*", folds.alias("folds"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), F.size(F.array_distinct(F.array_compact(turns))).alias("turns"))
    # Chunks have different numbers, so sorting compares these alone; that of null turns comes first.
    of = chunk.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "rows", "folds"))).alias("chunks"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
    )
    of = of.withColumn("rows", F.flatten(F.transform("chunks", lambda c: c["rows"])))
    begin = let(_begin("n"), lambda v: _inserted({x: v[x] for x in STATES}))
    of = of.withColumn("ends", F.aggregate(F.transform("chunks", lambda c: c["folds"]), begin, _joined))
    best = F.least(F.col("ends")["n"], F.col("ends")["a"])
    of = of.withColumn("best", best)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.coalesce((wide("high") - wide("low") + 1 - wide("turns")).cast("long"), F.lit(0).cast("long"))
    pair = lambda r, i: F.concat(F.get(r, i - 1)["initial"], F.get(r, i)["initial"])
    illegal = let(F.col("rows"), lambda r: F.size(F.filter(F.transform(r, lambda x, i: F.when(i > 0, ~pair(r, i).isin("su", "ua", "au")).otherwise(False)), lambda bad: bad)))
    return of.select(
        "conv_id", F.size("rows").cast("long").alias("rows"), gaps.alias("gaps"), "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"),
        F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), _turns(F.col("rows"), F.col("best.audit")).alias("repaired"),
    )


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_digest(conversations: DataFrame) -> DataFrame:
    """repair() of the damaged rows, for every conv_id that conversations has."""
    found = repair(damaged(conversations)).withColumn("digest", F.sha2(F.array_join("repaired", "\n").cast("binary"), 256))
    found = found.select(F.col("conv_id").alias("its_conv"), *COUNTS, "audit", "digest")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    met = every.join(found, F.col("conv_id").eqNullSafe(F.col("its_conv")), "left")
    zero, none = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    return met.select("conv_id", *(F.coalesce(c, zero).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", none).alias("repaired_sha256"))
