"""The ten operators and the pipeline against brute force, on small tables with nulls, ties, repeats and long texts."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import byte_bpe, exact_dedup, language_id, licenses, ngram_join, packing, queries, token_counts, token_files, topk, toxicity
from tidemark.llm.storage import new_path

EN = "the quick brown fox jumps over the lazy dog while it's raining on the green hills of the north "
FR = "le renard brun saute par-dessus le chien paresseux pendant qu'il pleut sur les collines vertes du nord "
TEXTS = [
    None, "", " \n\t", "one", "two words", EN * 3, EN * 3, EN * 3 + "end of it", FR * 4, EN * 400, "x" * 70_000, "ÀÉ́ İ 漢字 🙂 <|endoftext|> it's 'S  3.5\r\n",
    "Released under the MIT License. MIT licenses, mit-license; Apache License and GNU General Public LICENSE", "a b c d", "a b c d", "a b c", "!!! 123",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt int, row long, score double"
words_file, bytes_file, multi_file = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def le(ids):
    return np.asarray(ids, dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "fr" if t and "renard" in t else "en", "s", len(t or ""), 1, 2, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_op1_round_trip(spark, docs, empty):
    path, t = new_path(spark, "t"), Tokenizer.from_file(words_file)
    token_files.write_token_files(docs, path, words_file, 2)
    want = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in TEXTS]
    assert [r.ids for r in token_files.read_token_files(spark, path).orderBy("doc_id").collect()] == want
    starts = np.cumsum([0, *map(len, want)])[:-1].tolist()
    got = sorted(map(tuple, token_files.token_file_digest(spark, path).collect()))
    assert got == [(i, s, len(w), zlib.crc32(le(w))) for i, (s, w) in enumerate(zip(starts, want, strict=True))]
    token_files.write_token_files(empty, path + "e", words_file, 2)
    assert token_files.token_file_digest(spark, path + "e").count() == 0


def test_op2_base_places(docs, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for i, text in enumerate(TEXTS):
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and 0 <= r.score <= 1
    assert licenses.scan_licenses(empty).count() == 0


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            old, new = sorted((root[a], root[b]), reverse=True)
            root = [new if r == old else r for r in root]
    return [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_op3_against_all_pairs(spark, empty, n, percent):
    rng = np.random.default_rng(n)
    base = [f"w{k}" for k in rng.integers(0, 400, 120)]
    texts = list(TEXTS)
    for _ in range(40):
        w = list(base[: rng.integers(100, 121)])
        for k in rng.integers(0, len(w), rng.integers(0, 5)):
            w[k] = f"e{rng.integers(0, 50)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.jaccard_components(df, n, percent).collect())) == brute_components(texts, n, percent)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_op3_overlap_behind_one_prefix(spark):
    """A prefix gram of a that lies behind b's prefix is in their overlap; c, too short, is the anchor of all they share."""
    words = sorted((f"w{k}" for k in range(125)), key=lambda w: int(ngram_join.gram_sets([w], 1)[0][0]))
    shared = words[10:95]
    texts = [" ".join(t) for t in (shared + words[95:100], words[:10] + shared, shared[:5] + words[100:])]
    # A task for each text, so that no gram is counted as common and hashes alone set the order.
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 3), "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(df, 1, 85).collect())) == brute_components(texts, 1, 85) == [(0, 90, 0), (1, 95, 0), (2, 30, 2)]


def test_op3_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (0, 1, 30, 400, 5000):
        a, b = (np.unique(rng.integers(0, 2 * n + 1, n)) for _ in range(2))
        apart = sum(int(x).bit_count() for x in (ngram_join.parities(a) ^ ngram_join.parities(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))
        assert not (ngram_join.parities(a) ^ ngram_join.parities(a)).any()


def test_op3_trie_is_exact():
    rng = np.random.default_rng(1)
    anchor = np.unique(rng.integers(0, 2 * 10**18, 60))
    sets = [np.unique(np.concatenate([rng.choice(anchor, k, replace=False), rng.integers(0, 2 * 10**18, m)])) for k in range(40, 61, 2) for m in range(0, 12, 3)]
    want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, anchor)) >= 85 * len(np.union1d(s, anchor))]
    assert sorted(ngram_join.walk_trie(anchor, sets, 85)) == want


def test_op4_groups(docs, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[t or ""].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    twice = exact_dedup.exact_duplicates(docs.union(docs))
    assert twice.where("kept").count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.deduplicated(docs).columns == docs.columns


def test_op5_pieces_and_places(docs, empty):
    t = Tokenizer.from_file(bytes_file)
    got, sequences = packing.pack(docs, bytes_file, 2, 64).collect(), defaultdict(list)
    whole = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(TEXTS)}
    for r in got:
        assert zlib.crc32(le(whole[r.doc_id][r.start : r.start + r.length])) == r.ids_crc32 and r.length <= 64 and (r.length == 64 or r.piece == 0)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, whole.values()))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 64
    assert packing.pack(empty, bytes_file).count() == 0


def best_fit_rooms(counts, size):
    """The room that best-fit decreasing over single items leaves in each sequence."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [r for r in rooms if r >= length]
            rooms.remove(min(fit)) if fit else None
            rooms.append((min(fit) if fit else size) - length)
    return sorted(rooms)


def test_op5_plan_is_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.choice([10, 37, 100, 1024]))
        counts = {int(k): int(rng.integers(1, 40)) for k in rng.integers(1, size + 1, rng.integers(1, 12))}
        filled, ranks = defaultdict(list), defaultdict(list)
        for length, rank, items, each, first, offset in packing.plan(counts, size):
            ranks[length] += range(rank, rank + items)
            for j in range(items):
                filled[first + j // each].append((offset + j % each * length, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for places in filled.values():
            places.sort()
            assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
        assert sorted(size - sum(n for _, n in p) for p in filled.values()) == best_fit_rooms(counts, size)
    assert max(first for *_, first, _ in packing.plan({300: 4, 240: 3}, 1024)) == 1


def test_op6_like_tiktoken(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(multi_file, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: e.encode_ordinary(x or "") for i, x in enumerate(TEXTS)}
    encoded = byte_bpe.encode_documents(docs, multi_file, P.PATTERN)
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode_documents(encoded, multi_file, P.PATTERN).collect()} == {i: (x or "").encode() for i, x in enumerate(TEXTS)}
    assert {r.doc_id: r.ids_sha256 for r in byte_bpe.round_trip_digest(docs, multi_file, P.PATTERN).collect()} == {i: hashlib.sha256(le(w)).hexdigest() for i, w in want.items()}
    assert byte_bpe.round_trip_digest(empty, multi_file, P.PATTERN).count() == 0


@pytest.mark.parametrize("chunk", [50, 1000, 32768])
def test_op7_counts(docs, empty, chunk):
    t = Tokenizer.from_file(words_file)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, words_file, 2048, chunk, 16).collect()}
    for i, (size, n, over) in got.items():
        x = TEXTS[i] or ""
        assert (size, n, over) == (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids), n > 2048)
    assert token_counts.count_tokens(empty, words_file).count() == 0


def test_op8_languages(spark, docs, empty):
    rows = [(i, (EN if i % 2 else FR)[i % 40 :], "en" if i % 2 else "fr") for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(train)
    got = language_id.predict(train, model).join(train, "doc_id").where(language_id.fold() == 2).collect()
    assert got and all(r.lang == r.lang_pred for r in got)
    p = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [p[i].lang_pred for i in (0, 1, 2, 16)] == ["und"] * 4 and p[5].lang_pred == "en" and p[8].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in p.values())
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    # Each context's probabilities sum to one.
    lower = np.exp2(model.lower.astype(float)).reshape(-1, language_id.ALPHABET, 2).sum(axis=1)
    assert np.allclose(lower, 1, atol=1e-4)


def test_op8_limits_of_rare_languages(spark):
    """A language of few rows, none or few of them in the scale's sample, has a limit and rejects other texts."""
    rows = [(i, FR[i % 40 :] if i % 100 == 0 else EN[i % 40 :], "fr" if i % 100 == 0 else "en") for i in range(4000)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(train, sample=100)
    assert set(model.limits) == {"en", "fr"}
    known = train.where(language_id.fold() != 2).select("*", language_id.half().alias("half")).collect()
    # Each text is measured by a model counted on the other half of the training texts.
    models = []
    for k in (0, 1):
        counts = Counter((r.lang, int(g)) for r in known if r.half != k for g in language_id.codes(r.text))
        models.append(language_id.build(pd.DataFrame([(a, g, n) for (a, g), n in counts.items()], columns=["lang", "gram", "n"])))
    for k, lang in enumerate(model.languages):
        found = [models[r.half].surprisal(r.text) for r in known if r.lang == lang]
        own, sizes = np.array([bits[k] / n for bits, n, _ in found]), np.array([n for _, n, _ in found])
        median, spread, one, limit = model.limits[lang]
        assert own.min() <= median <= own.max() and np.isclose((own <= median).mean(), 0.5, atol=0.1)
        assert np.isclose(spread, max(0.02, own.std())) and np.isclose(one, max(0.5, np.sqrt(np.mean([v for _, _, v in found]))))
        beyond = (own - median) / np.sqrt(spread**2 + one**2 / sizes)
        assert np.isclose(limit, language_id.MARGIN * max(4.0, np.sort(beyond)[-(-len(beyond) * 999 // 1000) - 1]))
    assert language_id.accepted(spark.createDataFrame([(1, FR), (2, "пьёёё " * 200)], "doc_id long, text string"), model).collect() == [(1, FR)]


def test_op9_marginals_like_enumeration():
    f = toxicity.Field({"bad": 3}, np.array([-2.0, 0, 0, 1.5, 0, 0, 0]), np.array([[0.1, -1.0], [0.3, 0.5]]))
    s = [0, 3, 0, 0, 3, 3, 0]
    weight, ones = 0.0, np.zeros(len(s))
    for y in itertools.product((0, 1), repeat=len(s)):
        w = np.exp(sum(f.moves[a, b] + b * f.emission[k] for a, b, k in zip((0, *y), y, s, strict=False)))
        weight, ones = weight + w, ones + w * np.array(y)
    hits = [(i, k) for i, k in enumerate(s) if k]
    assert np.allclose(f.marginals(hits, len(s)), (ones / weight)[[i for i, _ in hits]])


def test_op9_scores(spark, docs, empty):
    rows = [(i, EN + ("you moron and clown" if i % 3 == 0 else "you there"), int(i % 3 == 0)) for i in range(120)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(train, train.select("doc_id", "toxic"))
    got = toxicity.score(train, model).join(train.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got)
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    spans = toxicity.offending(train.where("doc_id = 0"), model).collect()
    assert {rows[0][1][r.start : r.end] for r in spans} >= {"moron", "clown"}
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_op9_expected_counts_like_enumeration():
    emission, moves = np.array([-2.0, 0.3, 0, 1.5, 0, 0, 0]), np.array([[0.1, -1.0], [0.3, 0.5]])
    docs = [([0, 3, 0, 0, 3, 1, 0], 1), ([3, 0, 0, 0], 0), ([0, 0, 1], 1), ([0] * 5, 1), ([3], 1)]
    off, moved = np.zeros(7), np.zeros((2, 2))
    for s, toxic in docs:
        tagged = tuple(int(toxic and k > 0) for k in s)
        paths = list(itertools.product((0, 1), repeat=len(s)))
        w = np.array([np.exp(sum(moves[a, b] + b * emission[k] for a, b, k in zip((0, *y), y, s, strict=False))) for y in paths])
        for y, p in [(tagged, 1.0), *zip(paths, -w / w.sum(), strict=True)]:
            for a, b, k in zip((0, *y), y, s, strict=False):
                moved[a, b] += p
                off[k] += p * b
    chains = [toxicity.Chain(np.flatnonzero(s), np.array(s)[np.flatnonzero(s)], len(s), t) for s, t in docs]
    got = toxicity.Chains(chains).gradient(emission, moves)
    assert np.allclose(got[0], off) and np.allclose(got[1], moved)


@pytest.mark.parametrize("clean_words", [1, 60])
def test_op9_long_documents(spark, clean_words):
    """All labelled documents, or the toxic ones alone, have more than 1,000 words."""
    rows = [(i, EN * (60 if i % 3 == 0 else clean_words) + ("you moron and clown" if i % 3 == 0 else "you there"), int(i % 3 == 0)) for i in range(120)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(train, train.select("doc_id", "toxic"))
    got = toxicity.score(train, model).join(train.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got)


def test_op9_rare_words_of_many_documents(spark):
    """Five toxic documents are enough for a word, however many toxic ones there are."""
    rows = [(i, "you there moron" + (" clown" if i < 5 else ""), 1) for i in range(4000)] + [(i, "you there", 0) for i in range(4000, 44000)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert set(toxicity.strengths_of(train, 4000, 40000)) == {"moron", "clown"}


def test_op10_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)] + [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [float("nan")] * 4), (400, [float("inf")] * 4)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 100 = 0"), 10, shard_rows=10, block_rows=2).collect())
    m, want = np.array([r[1] for r in rows[:300]]) * 1024, []
    for q in (0, 100, 200):
        best = sorted((-int(m[q] @ m[c]), c) for c in range(300) if c != q)[:10]
        want += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, empty):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "exact_dedup", "ngram_jaccard_join", "best_fit_packing"]
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    want = {i for i, _, r in brute_components(TEXTS, 5, 80) if i == r}
    assert {r.doc_id for r in kept.collect()} == want
    assert corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, empty, ""), "").count() == 0


def test_repeated_doc_ids_leave_one_row_of_each_text(spark):
    near = EN * 30
    rows = [(1, near), (1, near), (1, FR * 9), (2, near), (2, near + "end"), (None, FR * 9), (3, "alone"), (3, "other")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long").repartition(3)
    exact = corpus_pipeline.drop_copies(spark, df, "")
    assert exact.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in exact.collect()) == sorted([(2, near), (2, near + "end"), (1, FR * 9), (3, "alone"), (3, "other")])
    left = corpus_pipeline.drop_near_copies(spark, df, "")
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, near), (1, FR * 9), (3, "alone"), (3, "other")])


def test_every_operator_is_a_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))
