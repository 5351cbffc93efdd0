"""Fingerprints, repair of conversations and resampling against second implementations, and their edge cases."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, fingerprints, resampling
from tidemark.llm.storage import stored

DOCS = "doc_id long, text string, print string, hash long"
TURNS = "conv_id long, turn long, role string, text string, rows int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def grams(text):
    w = re.split(r"[\x20\x09-\x0D]+", text.lower())
    w = [x for x in w if x]
    return {tuple(w[max(0, i - 4) : i + 1]) for i in range(len(w))}


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))


def edited(rows):
    """n_chars and edited text by place, rows in their order."""
    out = []
    for i, (_, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out.append((len(t), t[: len(t) - q] + after[:q]))
    return out


def test_fingerprints_follow_the_next_document_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    rng = random.Random(3)
    rows = [(i * 3 - 50, words(rng, rng.choice([0, 1, 3, 40, 200])) + rng.choice(["", " é", "\n漢字", "x"])) for i in range(60)]
    mixed = rows[:]
    rng.shuffle(mixed)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs(spark, mixed)).collect()}
    want = edited(rows)
    for (i, t), (n, e), (_, after) in zip(rows, want, rows[1:] + rows[:1], strict=True):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(e.encode()).hexdigest())
        for near, other in ((r["near_edited"], e), (r["near_next"], after)):
            a, b = grams(t), grams(other)
            if not a or not b:
                assert near == (1.0 if a == b else 0.0)
            else:
                assert abs(near - len(a & b) / len(a | b)) < 0.2
        assert len(r["fingerprint"]) == (256 if grams(t) else 0)


def test_likeness_is_unbiased(spark):
    rng = random.Random(5)
    pairs = []
    for k in range(120):
        a = words(rng, 300).split()
        b = a[: 300 - 3 * (k % 100)] + words(rng, 3 * (k % 100)).split()
        pairs.append((k, " ".join(a), " ".join(b), len(grams(" ".join(a)) & grams(" ".join(b))) / len(grams(" ".join(a)) | grams(" ".join(b)))))
    rows = spark.createDataFrame(pairs, "k int, a string, b string, true double")
    near = fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))
    off = np.array([r["near"] - r["true"] for r in rows.select("true", near.alias("near")).collect()])
    assert abs(off.mean()) < 0.02 and off.std() < 0.06
    assert off.size == 120


def test_densification_draws_from_filled_bins_alone(spark):
    """Each empty bin has the value of a filled one, texts of one run have that value everywhere, equal sets equal prints."""
    rows = docs(spark, [(1, "one"), (2, "ONE"), (3, "a b c d"), (4, "b a d c"), (5, "a  b\tc\nd ")])
    least = fingerprints.least_of_bins(fingerprints.runs(F.col("text")))
    got = {r["doc_id"]: r for r in rows.select("doc_id", least.alias("least"), fingerprints.densified(least).alias("dense"), fingerprints.as_hex(fingerprints.fingerprint(F.col("text"))).alias("p")).collect()}
    full = fingerprints.FULL
    for r in got.values():
        met = {x for x in r["least"] if x & full != full}
        assert len(r["least"]) == len(r["dense"]) == 128 and set(r["dense"]) <= met
        assert all(x == y for x, y in zip(r["least"], r["dense"], strict=True) if x & full != full)
    assert len(set(got[1]["dense"])) == 1 and got[1]["p"] == got[2]["p"] and got[3]["p"] == got[5]["p"] != got[4]["p"]


def test_fingerprints_of_odd_rows(spark):
    twice = "over and over the same row"
    rows = [(None, None), (None, "a b"), (7, twice), (7, twice), (7, twice), (7, "other"), (9, ""), (10, "  x" * 3), (11, "w " * 30_000)]
    got = fingerprints.fingerprints(docs(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows) and Counter(r["n_chars"] for r in got) == Counter(len(t or "") for _, t in rows)
    same = [r for r in got if r["n_chars"] == len(twice)]
    assert len(same) == 3 and len(set(same)) == 1
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0
    (one,) = fingerprints.fingerprints(docs(spark, [(1, "abcd efgh")])).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()


BLANKS = " \t\n\x0b\x0c\r"
STEP = {("n", "u"): "u", ("n", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL_ROLE = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        s = lambda v: " " if v is None else str(v)
        kind, r, x = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20, s(r), s(x)
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))


def repaired(rows):
    """The cheapest edits by trying all, least audit first; rows are few."""
    seen, faults = set(), []
    for _, r, x in rows:
        end = x.rstrip(BLANKS)
        faults.append("b" if not end else "d" if (r, x) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((r, x))

    @functools.cache
    def go(i, state, inserted):
        found = []
        add = lambda cost, letter, line, rest: rest and found.append((cost + rest[0], letter + rest[1], line + rest[2]))
        after = "a" if state == "u" else "u"
        if i == len(rows):
            if state in "na":
                found.append((0, "", ()))
        else:
            _, r, x = rows[i]
            add(2, "D", (), go(i + 1, state, 0))
            if faults[i] not in ("b", "d"):
                extra = 5 if faults[i] == "t" else 0
                if (state, r[:1]) in STEP:
                    add(extra, "K", (f"{r}:{x}",), go(i + 1, STEP[state, r[:1]], 0))
                add(extra + 1, "R", (f"{FULL_ROLE[after]}:{x}",), go(i + 1, after, 0))
        if inserted < 3:
            add(5, "I", (FULL_ROLE[after] + ":",), go(i, after, inserted + 1))
        return min(found, key=lambda v: v[:2]) if found else None

    cost, audit, lines = go(0, "n", 0)
    turns = [t for t, _, _ in rows if t is not None]
    first = [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("bits", [1, 5])
def test_repair_is_the_cheapest_whatever_the_chunks(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    rng, rows = random.Random(7), []
    for c in [None, *range(120)]:
        for t in range(rng.randint(1, 14)):
            turn = rng.choice([t, t, t, t, None, t + 3, -t])
            rows.append((c, turn, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No", "Why? ", "\x0b \t", None, f"So {t}.", f"end {t}", "a.b"])))
    got = conversations.repair_digest(spark.createDataFrame([(*r, 0) for r in rows], TURNS)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert len(got) == len(by)
    for r in got:
        assert tuple(r)[1:] == repaired(damage(by[r["conv_id"]]))


def test_repair_of_odd_conversations(spark):
    assert conversations.repair_digest(spark.createDataFrame([], TURNS)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (r,) = conversations.repair_digest(spark.createDataFrame([(gone, 0, "user", "Hi.", 0)], TURNS)).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # Thousands of turns and one very long text.
    rows = [(5, t, "user" if t % 2 else "assistant", f"{'x' * (200_000 if t == 9 else 3)} {t}.", 0) for t in range(3000)]
    (r,) = conversations.repair(spark.createDataFrame(rows, TURNS).drop("rows")).collect()
    assert r["rows"] == 3000 and len(r["audit"]) >= 3000 and set(r["audit"]) <= set("DIKR") and r["cost"] == 4 and r["repaired"][0] == "user:xxx 1."


def drawn(rows, target, k=1, buckets=10_000, least=20, percent=10, seed=2024):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(low))
    feats = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, k + 1) for i in range(len(w) - n + 1)]
    own = [(i, split(t)) for i, t in rows]
    s, t = Counter(b for _, w in own for b in feats(w)), Counter(b for x in target for b in feats(split(x)))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    found = []
    for i, w in own:
        f = feats(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    fit = sorted((r for r in found if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): n for n, r in enumerate(fit[: len(fit) * percent // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in found]


@pytest.mark.parametrize("k", [1, 3])
def test_resampling_equals_a_plain_count(spark, monkeypatch, k):
    monkeypatch.setattr(resampling, "PART", 64)
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 16)
    monkeypatch.setattr(resampling, "BLOCK_ENTRIES", 300)
    monkeypatch.setattr(resampling, "MOST_KNOWN", 50)
    rng = random.Random(11)
    rows = [(i, rng.choice(["", None, "Straße-9 ÷ x\x00y "]) if i % 9 == 0 else words(rng, rng.randint(15, 90)) + " Bench mark") for i in range(200)]
    rows += [(None, words(rng, 30)), (-4, "one " * 3000)]
    target = [words(rng, 60), None, "bench mark straße"]
    bench = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    got = resampling.resample(docs(spark, rows), bench, words=k, buckets=500, percent=25).collect()
    assert sorted(map(tuple, got), key=str) == sorted(drawn(rows, target, k, 500, percent=25), key=str)


def test_resampling_of_odd_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs(spark, []), none).count() == 0
    # Many rows with one doc_id and one text: all of one score, each with a rank of its own.
    got = resampling.resample(docs(spark, [(3, "w " * 25)] * 40 + [(4, "short")]), none).collect()
    assert len(got) == 41 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]


def test_row_groups_of_stored_blocks_are_bounded(spark):
    import glob

    import pyarrow.parquet as pq

    rows = docs(spark, [(i, " ".join(f"w{i}x{k}" for k in range(400))) for i in range(600)]).select("doc_id", "text")
    blocks = stored(resampling.csr_blocks(rows.coalesce(1).repartition(1), buckets=1 << 20).limit(600), "csr", 1 << 16)
    small = stored(spark.range(5000).selectExpr("id", "array_repeat(id * 7919, 50) AS x").coalesce(1), "small", 1 << 16)
    for table in (blocks, small):
        groups = [pq.ParquetFile(f).metadata for f in glob.glob(table.stored_at.removeprefix("file:") + "/*.parquet")]
        most = max(m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups))
        assert most <= 500 and sum(m.num_rows for m in groups) == table.count()
