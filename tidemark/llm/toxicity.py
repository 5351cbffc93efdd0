"""Toxic spans by a linear-chain conditional random field.

The labels mark documents, the field marks words. Over all labelled training documents Spark counts in how many toxic
and other ones each word stands; words that stand in toxic ones far more often than chance allows get a strength.
In the training documents a word counts as toxic if it has a strength and its document is labelled toxic. The field
(two states; features: the strength of a word, transitions) is fitted by likelihood on a bounded sample of these
documents. Forward-backward marginals give each word's probability; a document's score is a logistic function, fitted
on the same sample, of the odds that any word is toxic and of their expected number. Words without a strength have one
and the same feature, so the recursions cross a run of them by a power of one 2 x 2 matrix and touch only the others.

Edge cases: null and empty texts have the score of a text without a toxic word; without labels of both kinds every
score is 0; several labels of a document count as toxic if one does; rows with a null doc_id are scored, not trained
on; texts of any length are read whole; rows that share a doc_id, equal ones too, stay separate rows; an empty table
gives no rows; other columns, of whatever name, are not read. labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import filter_of

WORD = re.compile(r"[^\W\d_]+")
STRENGTHS = 6


def fold() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)), F.lit(1))


@dataclass
class Field:
    strengths: dict[str, int] = field(default_factory=dict)  # word -> 1 to STRENGTHS
    emission: np.ndarray = field(default_factory=lambda: np.zeros(STRENGTHS + 1))  # log odds of state 1 by strength
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log weight of state to state
    weights: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0, 0.0]))
    _powers: list[np.ndarray] = field(default_factory=list, repr=False)

    def plain_run(self, k: int) -> np.ndarray:
        """The matrix that crosses k words without a strength, scaled to a largest entry of 1."""
        if not self._powers:
            self._powers.append(np.exp(self.moves) * np.exp([0.0, self.emission[0]]))
        out, bit = np.eye(2), 0
        while k:
            if bit == len(self._powers):
                m = self._powers[-1] @ self._powers[-1]
                self._powers.append(m / m.max())
            if k & 1:
                out = out @ self._powers[bit]
                out = out / out.max()
            k, bit = k >> 1, bit + 1
        return out

    def hits(self, text: str) -> tuple[list[tuple[int, int]], int]:
        """(number of the word, strength) of the words with a strength, and the number of words."""
        words, known = WORD.findall(text.lower()), self.strengths
        return [(i, known[w]) for i, w in enumerate(words) if w in known], len(words)

    def marginals(self, hits: list[tuple[int, int]], n: int) -> np.ndarray:
        """P(toxic) of each hit, by forward and backward recursions over all n words."""
        if not hits:
            return np.zeros(0)
        steps, at = [], -1
        step = np.exp(self.moves)
        for i, s in hits:
            steps.append(self.plain_run(i - at - 1) @ step * np.exp([0.0, self.emission[s]]))
            at = i
        alpha, forward = np.array([1.0, 0.0]), []  # as if a clean word came before
        for m in steps:
            alpha = alpha @ m
            alpha = alpha / alpha.sum()
            forward.append(alpha)
        beta, out = self.plain_run(n - 1 - at) @ np.ones(2), []
        for k in range(len(hits) - 1, -1, -1):
            both = forward[k] * beta
            out.append(both[1] / both.sum())
            beta = steps[k] @ beta
            beta = beta / beta.sum()
        return np.array(out[::-1])

    def features(self, text: str | None) -> np.ndarray:
        return self.features_of(*self.hits(text or ""))

    def features_of(self, hits: list[tuple[int, int]], n: int) -> np.ndarray:
        m = self.marginals(hits, n)
        none = np.log1p(-np.minimum(m, 1 - 1e-6)).sum()
        odds = np.log(max(1e-6, -np.expm1(none))) - max(none, -14.0)
        return np.array([1.0, odds, np.log1p(m.sum())])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))

    def spans(self, text: str | None) -> list[dict]:
        """First and last character offsets and probability of the words more likely toxic than not."""
        if not text or not self.hits(text)[0]:
            return []  # offsets are found only where there is something to tag
        words = [(m.start(), m.end(), self.strengths.get(m.group().lower(), 0)) for m in WORD.finditer(text)]
        hits = [(i, s) for i, (_, _, s) in enumerate(words) if s]
        p = self.marginals(hits, len(words))
        return [{"start": words[i][0], "end": words[i][1], "p": float(q)} for (i, _), q in zip(hits, p, strict=True) if q >= 0.5]


def word_counts(train: DataFrame) -> DataFrame:
    """word, toxic, clean: in how many texts of train (text, toxic) each word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(found[0] | found[1])
            out = pa.record_batch([pa.array(words, pa.string()), *(pa.array([f[w] for w in words], pa.int64()) for f in (found[1], found[0]))], ["word", "toxic", "clean"])
            found[0].clear()
            found[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update(set(WORD.findall((text or "").lower())))
                if len(found[0]) + len(found[1]) > 300_000:
                    yield flush()
        yield flush()

    counted = train.select(F.col("text").cast("string"), F.col("toxic").cast("int")).mapInArrow(run, "word string, toxic long, clean long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def strengths_of(train: DataFrame, toxic: int, clean: int, least: int = 5) -> dict[str, int]:
    """Words far commoner in toxic documents. Each stands in `least` of these, whatever their number: evidence alone
    decides, so the words may grow in number with the vocabulary of the toxic documents."""
    n, share = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
    ratio = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / clean)
    beyond = (F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share))
    strong = word_counts(train).where((F.col("toxic") >= least) & (ratio >= 4) & (beyond >= 5))
    rows = strong.select("word", F.least(F.lit(STRENGTHS), F.floor(F.log2(ratio)) - 1).cast("int").alias("strength")).collect()
    return {r["word"]: max(1, r["strength"]) for r in rows}


@dataclass
class Chain:
    """A training document: the places and strengths of its words with a strength, how many words it has, its label."""

    at: np.ndarray
    s: np.ndarray
    n: int
    toxic: int

    def moves(self) -> np.ndarray:
        """How often each state follows each, from a clean word before the first one; toxic words are those at `at`."""
        if not self.toxic or not len(self.at):
            return np.array([[self.n, 0], [0, 0]])
        stay = int((np.diff(self.at) == 1).sum())
        leave = len(self.at) - stay - int(self.at[-1] == self.n - 1)
        return np.array([[self.n - len(self.at) - leave, len(self.at) - stay], [leave, stay]])


def plain_runs(m: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each length k: m ** k, and its derivatives by the logs of m's four entries, both by one and the same scale.

    Lengths are crossed bit by bit, so a run of any length costs the logarithm of its words."""
    power, slope = m / m.max(), np.zeros((4, 2, 2))
    slope.reshape(4, 4)[np.arange(4), np.arange(4)] = power.ravel()
    p, d, bit = np.tile(np.eye(2), (len(lengths), 1, 1)), np.zeros((len(lengths), 4, 2, 2)), 0
    while len(lengths) and lengths.max() >> bit:
        on = (lengths >> bit) & 1 == 1
        d[on] = p[on][:, None] @ slope + d[on] @ power
        p[on] = p[on] @ power
        scale = p.max(axis=(1, 2))
        p, d = p / scale[:, None, None], d / scale[:, None, None, None]
        slope = power @ slope + slope @ power
        power = power @ power
        slope, power, bit = slope / power.max(), power / power.max(), bit + 1
    return p, d


class Chains:
    """Tagged chains with similar numbers of hits, padded to one matrix of these, for expected counts by
    forward-backward. Plain words between hits are crossed by powers of one matrix, so that no length is too long."""

    def __init__(self, docs: list[Chain]):
        hits = np.array([len(d.at) for d in docs])
        self.s = np.zeros((len(docs), hits.max()), dtype=np.int64)
        runs = np.zeros((len(docs), hits.max() + 1), dtype=np.int64)  # plain words ahead of each hit; last, behind all
        for k, d in enumerate(docs):
            self.s[k, : len(d.s)] = d.s
            runs[k, : len(d.at)] = np.diff(d.at, prepend=-1) - 1
            runs[k, -1] = d.n - 1 - (d.at[-1] if len(d.at) else -1)
        self.live = np.arange(self.s.shape[1]) < hits[:, None]
        self.lengths, runs_at = np.unique(runs, return_inverse=True)
        self.runs = runs_at.reshape(runs.shape)
        self.seen = sum(d.moves() for d in docs)
        toxic = self.live & np.array([d.toxic for d in docs], dtype=bool)[:, None]
        self.tags = np.bincount(self.s[toxic], minlength=STRENGTHS + 1)

    def gradient(self, emission: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected counts, of emissions by strength and of moves."""
        m, e = np.exp(moves), np.exp(emission)[self.s]
        p, d = plain_runs(m * np.exp([0.0, emission[0]]), self.lengths)
        n, width = self.s.shape
        pairs, plain, ones = np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((n, width))

        def cross(t: int, left: np.ndarray, right: np.ndarray, live: np.ndarray) -> np.ndarray:
            """Add the expected moves within the runs ahead of hit t; returns the weights of the states before them."""
            run = p[self.runs[:, t]]
            back = np.einsum("nij,nj->ni", run, right)
            moved = np.einsum("ni,nkij,nj->nk", left, d[self.runs[:, t]], right) / (left * back).sum(axis=1)[:, None]
            plain[:] += moved[live].sum(axis=0).reshape(2, 2)
            return back / back.sum(axis=1, keepdims=True)

        forward, ahead_of = np.empty((width + 1, n, 2)), np.empty((width, n, 2))
        forward[0] = [1.0, 0.0]
        for t in range(width):
            ahead_of[t] = np.einsum("ni,nij->nj", forward[t], p[self.runs[:, t]])
            a = ahead_of[t] @ m
            a[:, 1] *= e[:, t]
            forward[t + 1] = np.where(self.live[:, t, None], a / a.sum(axis=1, keepdims=True), forward[t])
        beta = cross(width, forward[width], np.ones((n, 2)), np.ones(n, dtype=bool))
        for t in range(width - 1, -1, -1):
            live = self.live[:, t]
            ahead = beta * np.stack([np.ones(n), e[:, t]], axis=1)
            both = ahead_of[t][:, :, None] * m * ahead[:, None, :]
            both /= both.sum(axis=(1, 2), keepdims=True)
            both *= live[:, None, None]
            pairs += both.sum(axis=0)
            ones[:, t] = both[:, :, 1].sum(axis=1)
            beta = np.where(live[:, None], cross(t, forward[t], ahead @ m.T, live), beta)
        off = self.tags - np.bincount(self.s[self.live], ones[self.live], minlength=STRENGTHS + 1)
        off[0] -= plain[:, 1].sum()
        return off, self.seen - pairs - plain


def fit_field(model: Field, docs: list[Chain], steps: int = 60, rate: float = 0.4, decay: float = 0.02) -> None:
    """Maximise the tags' likelihood, with a small quadratic penalty, by Adam."""
    docs = sorted((d for d in docs if d.n), key=lambda d: len(d.at))
    size = max(1, -(-len(docs) // 6))
    groups = [Chains(docs[k : k + size]) for k in range(0, len(docs), size)]
    words = max(1, sum(d.n for d in docs))
    x, first, second = np.zeros(STRENGTHS + 5), np.zeros(STRENGTHS + 5), np.zeros(STRENGTHS + 5)
    x[0] = -4.0
    for step in range(1, steps + 1):
        g = -decay * x
        for group in groups:
            e, m = group.gradient(x[: STRENGTHS + 1], x[STRENGTHS + 1 :].reshape(2, 2))
            g += np.concatenate([e, m.ravel()]) / words * 1000
        first, second = 0.8 * first + 0.2 * g, 0.95 * second + 0.05 * g * g
        x += rate / (1 + step / 20) * (first / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-6)
    model.emission, model.moves = x[: STRENGTHS + 1], x[STRENGTHS + 1 :].reshape(2, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the first column is the intercept."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[penalty] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        w = w + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ w), -3, 3)
    return w


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 0, sample: int = 1500) -> Field:
    """Learn from documents outside the held-out fold. Word counts take all of them; the field and the score's
    weights about `sample` of either label, of any length."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Only texts that may have a label are shuffled.
    may_hold = filter_of(known, "labelled_id")
    train = texts.where(may_hold(F.col("doc_id"))).join(known.hint("shuffle_hash"), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "toxic")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    model = Field()
    if not toxic or not clean:
        return model
    model.strengths = strengths_of(train, toxic, clean)
    one_in = {t: max(1, sizes[t] // sample) for t in (0, 1)}
    chance = F.pmod(F.xxhash64("labelled_id"), F.when(F.col("toxic") == 1, one_in[1]).otherwise(one_in[0]))
    # About 2 * sample rows by their hash, whatever the number of labels.
    some = texts.join(F.broadcast(known.where(chance == 0)), F.col("doc_id") == F.col("labelled_id")).select("text", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model.strengths)

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                words = WORD.findall(text.lower())
                at = [(i, shared.value[w]) for i, w in enumerate(words) if w in shared.value]
                rows.append(([i for i, _ in at], [k for _, k in at], len(words)))
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
            yield pa.record_batch([*(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)), batch.column(1).cast(pa.int32())], ["at", "strengths", "n", "toxic"])

    rows = some.mapInArrow(tags, "at array<int>, strengths array<int>, n int, toxic int").collect()
    chains = [Chain(np.array(r["at"], dtype=np.int64), np.array(r["strengths"], dtype=np.int64), r["n"], r["toxic"]) for r in rows]
    if not chains:
        return model
    chains.sort(key=lambda c: (c.toxic, c.n, c.at.tobytes(), c.s.tobytes()))
    fit_field(model, chains)
    x = np.array([model.features_of(list(zip(c.at.tolist(), c.s.tolist(), strict=True)), c.n) for c in chains])
    y = np.array([c.toxic for c in chains])
    model.weights = fit_logistic(x, y, np.where(y == 1, one_in[1], one_in[0]).astype(float))
    return model


def scorer(model: Field, spark) -> Column:
    """A function of a text column: struct of score, predicted."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, predicted int")
    def score_text(texts: pd.Series) -> pd.DataFrame:
        p = np.array([shared.value.score(t) for t in texts], dtype=float)
        return pd.DataFrame({"score": p, "predicted": (p >= 0.5).astype("int32")})

    return score_text


def score(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", scorer(model, docs.sparkSession)("text").alias("p")).select("doc_id", "p.*")


def tagged(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score, predicted and spans (start, end, p of each word that is more likely toxic than not) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, predicted int, spans array<struct<start:long,end:long,p:double>>")
    def tag(texts: pd.Series) -> pd.DataFrame:
        p = np.array([shared.value.score(t) for t in texts], dtype=float)
        spans = [shared.value.spans(t) for t in texts]
        return pd.DataFrame({"score": p, "predicted": (p >= 0.5).astype("int32"), "spans": spans})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", tag("text").alias("p")).select("doc_id", "p.*")


def offending(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, start, end, p of every word that is more likely toxic than not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = F.pandas_udf("array<struct<start:long,end:long,p:double>>")(_spans_of(shared))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(found(F.col("text").cast("string"))).alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.p")


def _spans_of(shared):
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.spans(t) for t in texts])

    return spans


def clean(docs: DataFrame, model: Field) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns as they are."""
    return docs.where(scorer(model, docs.sparkSession)(F.col("text").cast("string"))["predicted"] == 0)
