"""Language identification by interpolated Kneser-Ney character models.

Texts become symbols of a small alphabet: a to z, SHARED classes for all other letters, and one symbol for any run of
other characters. Counts of 4-grams per language are taken over all training texts, summed by Spark, and turned into
one model: a sorted array of the 4-grams seen in any language with the log probability under each, and tables for the
backoff to 3-grams. The alphabet bounds it: ALPHABET ** 4 entries a language, however large the corpus. A text goes
to the language of the lowest cross-entropy per symbol.

Calibration: the counts are also kept by halves of the training texts, and a model of one half tells the cross-entropy
of the texts of the other, so that no text is measured by a model that has seen it. From these, over all training
texts, come each language's usual cross-entropy, its spread, and the limit that REFUSED of its texts lie beyond, with a
margin; a text beyond its language's limit is rejected and its score lowered. A language needs LEAST texts with letters
for a limit, at any size. A scale for the score is fitted on about `sample` of them.

Edge cases: lang_pred is `und` and score 0 if the text is null or has no letter, or if nothing could be learned; ties
go to the language that sorts first; rows with a null doc_id or lang are not trained on, but predicted; texts of
any length are read whole; rows that share a doc_id, equal ones too, stay separate rows; an empty table gives no rows;
other columns, of whatever name, are not read. lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import release, stored

SHARED = 21
ALPHABET = 27 + SHARED
ORDER = 4
LEAST = 5
REFUSED, MARGIN = 0.001, 1.5  # part of a language's texts that may lie beyond its limit, and how much further that is set


def fold() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)), F.lit(0))


_table: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Symbol of each code point."""
    if not _table:
        out = np.zeros(0x110000, dtype=np.uint8)
        for cp in range(0x110000):
            if chr(cp).isalpha():
                low = ord(chr(cp).lower()[0])
                out[cp] = low - 96 if 97 <= low <= 122 else 27 + low % SHARED
        _table.append(out)
    return _table[0]


def codes(text: str) -> np.ndarray:
    """The text's 4-grams, each a number in base ALPHABET; empty without letters."""
    s = symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    s = s[(s != 0) | np.concatenate([[True], s[:-1] != 0])] if len(s) else s
    if not s.any():
        return np.zeros(0, dtype=np.uint32)
    s = np.concatenate([np.zeros(ORDER - 1, np.uint32), s[int(s[0] == 0) :].astype(np.uint32), np.zeros(int(s[-1] != 0), np.uint32)])
    out = s[: len(s) - ORDER + 1].copy()
    for k in range(1, ORDER):
        out = out * np.uint32(ALPHABET) + s[k : len(s) - ORDER + 1 + k]
    return out


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # ascending
    logs: np.ndarray  # of each gram, by language: log2 P(last symbol | three before)
    backoff: np.ndarray  # of each 3-symbol context, by language: log2 of the weight left for 3-grams
    lower: np.ndarray  # of each 3-gram, by language: log2 P(last symbol | two before)
    scale: float = 1.0
    limits: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)  # mean, spread, spread of a symbol, limit

    def surprisal(self, text: str | None) -> tuple[np.ndarray, int, float]:
        """Total bits by language, number of symbols, and variance of a symbol's bits under the best language."""
        g = codes(text) if text and self.languages else np.zeros(0, np.uint32)
        if not len(g):
            return np.zeros(len(self.languages)), 0, 0.0
        at = np.searchsorted(self.grams, g)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == g
        bits = np.empty((len(g), len(self.languages)), dtype=np.float32)
        bits[known] = self.logs[at[known]]
        rest = g[~known]
        bits[~known] = self.backoff[rest // ALPHABET] + self.lower[rest % ALPHABET ** (ORDER - 1)]
        total = -bits.sum(axis=0, dtype=np.float64)
        return total, len(g), float(bits[:, int(total.argmin())].var())

    def decide(self, total: np.ndarray, n: int) -> tuple[str, float, bool]:
        if not n:
            return "und", 0.0, True
        best = int(total.argmin())
        lang, p = self.languages[best], float(1 / np.exp2(-(total - total[best]) * self.scale).sum())
        if lang not in self.limits:
            return lang, p, False
        mean, spread, one, limit = self.limits[lang]
        beyond = (total[best] / n - mean) / np.sqrt(spread**2 + one**2 / n)
        return (lang, p, False) if beyond <= limit else (lang, p / 2 * limit / beyond, True)


def kneser_ney(counts: np.ndarray, order: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From counts of order-grams: discounted P per gram, weight of the lower order per context, discount applied.

    below: P of the lower order, for each of its grams. Dense tables; only used for orders under ORDER.
    """
    d = discount(counts)
    total = counts.reshape(-1, ALPHABET).sum(axis=1)
    kinds = (counts > 0).reshape(-1, ALPHABET).sum(axis=1)
    left = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    p = np.maximum(counts - d, 0) / np.repeat(np.maximum(total, 1), ALPHABET)
    context = np.arange(ALPHABET**order) // ALPHABET
    return p + left[context] * below[np.arange(ALPHABET**order) % ALPHABET ** (order - 1)], left, np.array(d)


def discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def build(table: pd.DataFrame, names: list[str] | None = None) -> Model:
    """The model from rows lang, gram, n; with names, in order, lang is a place among them."""
    languages = sorted(table["lang"].unique())
    grams = np.unique(table["gram"].to_numpy(np.uint32))
    contexts = ALPHABET ** (ORDER - 1)
    logs = np.zeros((len(grams), len(languages)), np.float32)
    backoff = np.zeros((contexts, len(languages)), np.float32)
    lower = np.zeros((contexts, len(languages)), np.float32)
    for k, lang in enumerate(languages):
        own = table[table["lang"] == lang].sort_values("gram")
        g, n = own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)
        kinds = [np.bincount(g % contexts, minlength=contexts)]  # of how many grams each shorter one is the end
        while len(kinds[-1]) > ALPHABET:
            last = kinds[-1]
            size = len(last) // ALPHABET
            kinds.append((last.reshape(ALPHABET, size) > 0).sum(axis=0))
        p = np.full(1, 1 / ALPHABET)
        for order, c in enumerate(reversed(kinds), 1):
            p, _, _ = kneser_ney(c.astype(np.float64), order, p)
        d = discount(n)
        total = np.bincount(g // ALPHABET, n, minlength=contexts)
        left = np.where(total > 0, d * np.bincount(g // ALPHABET, minlength=contexts) / np.maximum(total, 1), 1.0)
        seen = np.zeros(len(grams))
        seen[np.searchsorted(grams, g)] = np.maximum(n - d, 0) / total[g // ALPHABET]
        logs[:, k] = np.log2(seen + left[grams // ALPHABET] * p[grams % contexts])
        backoff[:, k], lower[:, k] = np.log2(np.maximum(left, 1e-12)), np.log2(p)
    return Model([names[x] if names else str(x) for x in languages], grams, logs, backoff, lower)


def half() -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id").cast("long")), F.lit(2)).cast("int")


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, half, gram, n over every text of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[tuple[str, int], list[np.ndarray]] = defaultdict(list)
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, part), parts in pending.items():
                u, c = np.unique(np.concatenate(parts), return_counts=True)
                cols = [pa.array([lang] * len(u), pa.string()), pa.array(np.full(len(u), part, np.int32)), pa.array(u.astype("i8")), pa.array(c.astype("i8"))]
                yield pa.record_batch(cols, ["lang", "half", "gram", "n"])
            pending.clear()

        for batch in batches:
            for lang, part, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                g = codes(text)
                pending[lang, part].append(g)
                held += len(g)
                if held > 8_000_000:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select(F.col("lang").cast("string"), half(), F.col("text").cast("string"))
    return rows.mapInArrow(run, "lang string, half int, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, held_out: int = 2, sample: int = 2000) -> Model:
    """The model learned from text and lang of the rows outside the held-out fold."""
    train = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != held_out))
    # At most ALPHABET ** ORDER rows a language and half: the alphabet bounds what comes to the driver, not the corpus.
    # Languages come as numbers, and the counts go before anything else is made.
    counts = stored(gram_counts(train), "grams")
    languages = sorted(str(r["lang"]) for r in counts.select("lang").distinct().collect())
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1 if languages else F.lit(0)
    table = counts.select(place.cast("int").alias("lang"), "half", F.col("gram").cast("int"), "n").toPandas()
    release(counts)
    model = build(table.groupby(["lang", "gram"], as_index=False)["n"].sum(), languages)
    if not model.languages:
        return model
    # A half that lacks a language can't measure it; where that is so (tiny tables), the whole model stands in.
    by_half = [build(table[table["half"] == k], languages) for k in (0, 1)]
    del table
    other = [by_half[1 - k] if by_half[1 - k].languages == model.languages else model for k in (0, 1)]
    one_in = max(1, train.count() // sample)
    rows = surprisals(train.select(F.col("lang").cast("string").alias("lang"), half().alias("half"), "text", "doc_id"), other)
    # Stored, as a text's cross-entropy is dear; the bits of every language only for the sample.
    own = F.element_at("bits", F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang")).cast("int")) / F.col("n")
    sampled = F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0
    kept = stored(rows.where("n > 0").select("lang", own.alias("own"), "n", "variance", F.when(sampled, F.col("bits")).alias("bits")), "surprisals")
    calibrate(model, kept.where("bits is not null").select("lang", "bits", "n").toPandas())
    model.limits = limits_of(kept)
    release(kept)
    return model


def surprisals(docs: DataFrame, models: list[Model]) -> DataFrame:
    """lang, doc_id, bits by language, n, variance of docs (lang, half, text, doc_id), each by the model of its half."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value[k].surprisal(t) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kinds = [pa.list_(pa.float64()), pa.int64(), pa.float64()]
            yield pa.record_batch([batch.column(0), batch.column(3), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["lang", "doc_id", "bits", "n", "variance"])

    rows = docs.select("lang", "half", "text", F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "lang string, doc_id long, bits array<double>, n long, variance double")


def calibrate(model: Model, rows: pd.DataFrame) -> None:
    """Fit the score's scale by likelihood."""
    rows = rows[rows["n"] > 0]
    if not len(rows):
        return
    bits = np.stack(rows["bits"].to_numpy())
    truth = np.array([model.languages.index(x) for x in rows["lang"]])
    above = bits - bits[np.arange(len(bits)), truth][:, None]

    def loss(scale: float) -> float:
        return float(np.log2(np.exp2(np.clip(-above * scale, -500, 500)).sum(axis=1)).mean())

    model.scale = min((0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0), key=loss)


def limits_of(kept: DataFrame) -> dict[str, tuple[float, float, float, float]]:
    """Each language's usual cross-entropy, its spread, that of a symbol, and the limit in their terms, over all rows
    (lang, own cross-entropy, n, variance)."""
    found = kept.groupBy("lang").agg(
        F.count("*").alias("texts"), F.percentile_approx("own", 0.5, 10_000).alias("median"), F.stddev_pop("own").alias("spread"),
        F.count_if(F.col("n") >= 200).alias("n_long"), F.stddev_pop(F.when(F.col("n") >= 200, F.col("own"))).alias("spread_long"), F.avg("variance").alias("variance"),
    )
    spread = F.greatest(F.when(F.col("n_long") >= LEAST, F.col("spread_long")).otherwise(F.col("spread")), F.lit(0.02))
    usual = found.where(F.col("texts") >= LEAST).select("lang", "median", spread.alias("spread"), F.greatest(F.sqrt("variance"), F.lit(0.5)).alias("one"))
    beyond = (F.col("own") - F.col("median")) / F.sqrt(F.col("spread") ** 2 + F.col("one") ** 2 / F.col("n"))
    # A row for each language is broadcast; there are no more languages than the model has.
    limits = kept.join(F.broadcast(usual), "lang").groupBy("lang", "median", "spread", "one").agg(F.percentile_approx(beyond, 1 - REFUSED, 100_000).alias("limit"))
    return {r["lang"]: (r["median"], r["spread"], r["one"], MARGIN * max(4.0, r["limit"])) for r in limits.collect()}


def predictor(model: Model, spark) -> Column:
    """A function of a text column: struct of lang_pred, score, rejected."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict_text(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        rows = [m.decide(*m.surprisal(t)[:2]) for t in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return predict_text


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", predictor(model, docs.sparkSession)("text").alias("p")).select("doc_id", "p.*")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is in a learned language, all columns as they are."""
    return docs.where(~predictor(model, docs.sparkSession)(F.col("text").cast("string"))["rejected"])
