"""Counts of texts with long stretches without blanks, and offsets of toxic words."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_counts, toxicity
from tidemark.llm.encoding import encoder

PATH = P.path("word_bpe_49k.json")


def counted(text, chunk, overlap):
    """The count, and how many characters were encoded for it."""
    enc, seen = encoder(PATH), []

    def tokens(x):
        seen.append(len(x))
        return token_counts.chunk_tokens(enc, x)

    def count(x):
        seen.append(len(x))
        return len(enc.ids(x)) // 4

    return token_counts.count_spliced(text, tokens, count, chunk, overlap), sum(seen)


@pytest.mark.parametrize(("chunk", "overlap"), [(20, 4), (50, 16), (400, 32)])
def test_counts_are_the_librarys_wherever_blanks_are(chunk, overlap):
    rng, library = random.Random(chunk), Tokenizer.from_file(PATH)
    parts = ["it's", "a", "Größe", "x" * 70, "漢字" * 20, "3.5", "\n\n", "<|endoftext|>", "[UNK]", "é́", "!?" * 15, "y" * 400, "\t", "🙂"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 60)))
        assert counted(text, chunk, overlap)[0] == len(library.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("text", ["x" * 200_000, "漢" * 50_000, "word " * 9_000 + "z" * 200_000, "z" * 200_000 + " word" * 9_000, ("y" * 60_000 + " ") * 4, "!a" * 60_000], ids=range(6))
def test_no_character_is_encoded_many_times(text):
    n, encoded = counted(text, 32_768, 512)
    assert n == len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)
    assert encoded <= 1.2 * len(text) + 70_000


def test_spans_come_with_the_scores(spark):
    plain, bad = "the fox sees a İ dog and ", "you MORON and clown"
    rows = [(i, plain * (1 + i % 4) + (bad if i % 3 == 0 else "you there"), int(i % 3 == 0)) for i in range(120)] + [(500, None, 0), (501, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    text, got = {i: t for i, t, _ in rows}, {r.doc_id: r for r in toxicity.tagged(docs, model).collect()}
    scores = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, model).collect()}
    assert {i: (r.score, r.predicted) for i, r in got.items()} == scores and len(got) == len(rows)
    for i, r in got.items():
        words = {text[i][s.start : s.end] for s in r.spans}
        assert words >= {"MORON", "clown"} if i % 3 == 0 and i < 500 else not words
        assert all(s.p >= 0.5 for s in r.spans)
    found = {(r.doc_id, r.start, r.end) for r in toxicity.offending(docs, model).collect()}
    assert found == {(i, s.start, s.end) for i, r in got.items() for s in r.spans}
