"""Language model, hard negatives and spelling variants against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import hard_negatives, language_model, queries, spelling, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TEXTS = "n_words string, doc_id long, text string, kind int, slice string, counts array<int>"


def frame(spark, rows):
    return spark.createDataFrame([("mine", i, t, 7, "mine", [1]) for i, t in rows], TEXTS).repartition(3)


# --- words ---------------------------------------------------------------------


def thue_morse(length: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(length))


def test_words_that_a_polynomial_confuses_have_different_hashes():
    texts = [thue_morse(size, *pair) for size in (1024, 2048, 4096) for pair in (("a", "b"), ("b", "a"))]
    texts += ["a" * n for n in range(1, 300)] + ["", "é", "abcdefgh", "abcdefgi", "bbcdefgh", "abcdefgh\x00"]
    joined = " ".join(texts).encode()
    offsets = np.array([0, len(joined)])
    found = words.split_words(np.frombuffer(joined, dtype=np.uint8), offsets)
    assert len(found.hashes) == len(texts) - 1 == len(set(found.hashes.tolist()))
    again = words.split_words(np.frombuffer(joined[2:], dtype=np.uint8), np.array([0, len(joined) - 2]))
    assert again.hashes[5:].tolist() == found.hashes[5:].tolist()
    sequences = [thue_morse(size, *pair) for size in (1024, 2048) for pair in (("x ", "y "), ("y ", "x "))]
    data, limits = "".join(sequences).encode(), np.cumsum([0, *(len(s) for s in sequences)])
    assert len(set(words.split_words(np.frombuffer(data, dtype=np.uint8), limits).text_hashes().tolist())) == 4


# --- language model ------------------------------------------------------------


def plain_counts(rows, order):
    tokens = [[w.translate(LOWER) for w in WORD.findall(t or "")] + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    grams = [Counter() for _ in range(order + 1)]
    for own, out in zip(tokens, held, strict=True):
        padded = ["<start>"] * (order - 1) + own
        for k in range(len(own) if not out else 0):
            for level in range(1, order + 1):
                grams[level][tuple(padded[k + order - level : k + order])] += 1
    return tokens, held, grams


def plain_scores(rows, order, weights):
    tokens, held, grams = plain_counts(rows, order)
    contexts = [Counter() for _ in range(order + 1)]
    for level in range(2, order + 1):
        for gram, n in grams[level].items():
            contexts[level][gram[:-1]] += n
    total, known = grams[1].total(), len(grams[1])
    result = Counter()
    for (doc_id, _), own, out in zip(rows, tokens, held, strict=True):
        padded, base, score, seen = ["<start>"] * (order - 1) + own, 0.0, 0.0, 0
        for k, word in enumerate(own):
            n = grams[1][word,]
            p, bucket = [1 / (known + 1), n / total if total else 1 / (known + 1)], 0
            for level in range(2, order + 1):
                gram = tuple(padded[k + order - level : k + order])
                context = contexts[level][gram[:-1]]
                p.append(grams[level][gram] / context if context else 0)
                if context:
                    bucket = (level - 1) * language_model.CONTEXT_BUCKETS + int(math.log2(context))
            seen += n > 0
            base += math.log10((n + 1) / (total + known + 1))
            score += math.log10(sum(w * x for w, x in zip(weights[bucket], p, strict=True)))
        result[doc_id, out, len(own), seen, total, round(base, 7), round(score, 7)] += 1
    return result


def sample_texts():
    rng = random.Random(3)
    syllables, ends = ["the", "Of", "an", "bé", "x"], ["", "a", "b"]
    rows = [
        (i, " ".join(rng.choice(syllables) + rng.choice(ends) + ("" if rng.random() < 0.8 else str(rng.randrange(99))) for _ in range(rng.randrange(80))))
        for i in range(300)
    ]
    rows += [(None, "the of"), (7, None), (7, ""), (9, "the a"), (9, "the a"), (16, "zzz " * 3), (5000, "q" * 4000 + " The")]
    return rows


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_plain_counts(spark, order):
    rows = sample_texts()
    model = language_model.fit(frame(spark, rows), order=order)
    found = Counter((*r[:5], round(r[5], 7), round(r[6], 7)) for r in model.scores().collect())
    assert found == plain_scores(rows, order, model.weights)
    assert np.allclose(model.weights.sum(axis=1), 1) and (model.weights[:, 0] > 0).all()


def test_slices_and_buckets_of_any_size_give_the_same_scores(spark, monkeypatch):
    rows = sample_texts()
    whole = language_model.score_documents(frame(spark, rows)).collect()
    small = language_model._Buckets((3, 7))
    monkeypatch.setattr(language_model._Buckets, "over", classmethod(lambda cls, tokens, order: small))
    cut = language_model.score_documents(frame(spark, rows).repartition(40)).collect()
    assert Counter((r.doc_id, round(r.score, 7)) for r in whole) == Counter((r.doc_id, round(r.score, 7)) for r in cut)


def test_probabilities_of_a_context_add_up_to_one(spark):
    rows = [(i, t) for i, t in sample_texts() if i is not None]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    vocabulary = sorted({w.translate(LOWER) for _, t in rows for w in WORD.findall(t or "")})
    tried = [*vocabulary, "neverseen"]
    new = [k for k in range(10**6, 10**6 + 20 * len(tried)) if zlib.crc32(str(k).encode()) % 7 == 2][: len(tried)]
    both = rows + list(zip(new, (f"the {w}" for w in tried), strict=True))
    out = {r.doc_id: r.score for r in language_model.score_documents(frame(spark, both)).collect()}
    model = language_model.fit(frame(spark, rows))
    _, _, grams = plain_counts(rows, 2)
    ends = {w: sum(n for g, n in grams[2].items() if g[0] == w) for w in tried}

    def probability(before, word):
        n, context = grams[1][word,], sum(n for g, n in grams[2].items() if g[0] == before)
        p = [1 / (len(grams[1]) + 1), n / grams[1].total(), grams[2][before, word] / context if context else 0]
        return float(model.weights[64 + int(math.log2(context)) if context else 0] @ p)

    assert abs(sum(probability("the", w) for w in [*tried, None]) - 1) < 1e-9 and ends
    start = math.log10(probability("<start>", "the"))
    got = sum(10 ** (out[k] - start - math.log10(probability(w, None))) for k, w in zip(new, tried, strict=True))
    assert abs(got + probability("the", None) - 1) < 1e-6


def test_weights_follow_the_held_out_part():
    """Against expectation-maximisation over the exact estimates, one token at a time."""
    rng = np.random.default_rng(4)
    p = np.stack([np.full(500, 1e-3), rng.choice([0, 0.01, 0.2], 500), rng.choice([0, 0.5, 0.9], 500)])
    exact = np.full(3, 1 / 3)
    for _ in range(300):
        share = exact[:, None] * p
        exact = (share / share.sum(axis=0)).sum(axis=1) + 1
        exact /= exact.sum()
    cells = np.full(500, language_model.CONTEXT_BUCKETS + 3)
    for sizes in language_model.relative_sizes(p):
        cells = cells * (language_model.ZERO + 1) + sizes
    cell, n = np.unique(cells, return_counts=True)
    weights = language_model.learn_weights(cell, n, 2)
    assert np.abs(weights[language_model.CONTEXT_BUCKETS + 3] - exact).max() < 0.02
    assert weights[language_model.CONTEXT_BUCKETS + 9].tolist() == weights[language_model.CONTEXT_BUCKETS + 3].tolist()
    assert np.allclose(language_model.learn_weights(cell[:0], n[:0], 2)[0], [0.5, 0.5, 0])


def test_held_out_texts_are_more_likely_than_under_the_base(spark):
    found = queries.QUERIES["op11_lm_scores"](spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert found.score.sum() > 0.95 * found.base_score.sum() and len(found)


def test_no_documents_and_no_training_documents(spark):
    assert language_model.score_documents(frame(spark, [])).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (row,) = language_model.score_documents(frame(spark, [(held, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.held_out) == (3, 0, 0, 0.0, True)


# --- hard negatives ------------------------------------------------------------

VECTORS = "rank string, vec_id long, embedding array<float>, label int, tile string, vector int"


def vectors(spark, rows):
    return spark.createDataFrame([("mine", *r, "mine", 3) for r in rows], VECTORS).repartition(3)


def plain_negatives(rows):
    own = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    result = Counter()
    for a, (i, label, vector) in enumerate(own):
        if i % 100:
            continue
        score = [sum(x * y for x, y in zip(vector, other, strict=False)) for _, _, other in own]
        positives = sorted((-score[b], own[b][0]) for b in range(len(own)) if b != a and own[b][1] == label)[:5]
        others = sorted((-score[b], own[b][0]) for b in range(len(own)) if own[b][1] != label)
        for minus, positive in positives:
            inside = [(s, j) for s, j in others if -80 * minus <= -100 * s <= -100 * minus][:5]
            for rank, (s, j) in enumerate(inside, start=1):
                result[i, positive, rank, j, -minus, -s] += 1
    return result


def odd_vectors():
    rng = random.Random(2)

    def vector(size):
        return [float(np.float32(rng.uniform(-1, 1))) for _ in range(size)]

    rows = [(k * 10 if k % 3 else k * 100, vector(rng.choice([4, 4, 4, 3])), rng.randrange(3)) for k in range(400)]
    rows += [(1, None, 2), (2, [1.0, None], 1), (3, [math.nan], 1), (4, [math.inf], 1), (None, [1.0], 1), (5, [0.5], None)]
    rows += [(100, [], 1), (700, [0.5, 0.5, 0.5, 0.5], 0), (400, [3e3, 0.0, 0.0, 1.0], 1), (300, [7e6, 0.0, 0.0, 1.0], 1)]
    rows += [(301, [6e6, 0.0, 0.0, 1.0], 2), (303, [7e6, 0.5, 0.0, 1.0], 1)] + [(200, [0.5, 0.5, 0.5, 0.5], 1)] * 3
    return rows + [(100000 + k, [0.5, 0.25, 0.5, 0.5], 0) for k in range(300)]  # one vector, a third of the rows


def test_negatives_are_those_of_all_products(spark):
    rows = odd_vectors()
    found = Counter(tuple(r) for r in hard_negatives.mine_negatives(vectors(spark, rows)).collect())
    assert found == plain_negatives(rows) and len(found) > 500


@pytest.mark.parametrize("size", [1, 5, 64, 65, 1000])
def test_a_tree_finds_what_a_scan_finds(size):
    rng = np.random.default_rng(size)
    rows = rng.integers(-50, 50, (size, 6))
    rows[size // 2 :] = rows[0]
    order = hard_negatives.tile_order(rows, hard_negatives.PAGE_ROWS)
    assert sorted(order.tolist()) == list(range(size))
    ids = np.arange(size) * 3
    tree = hard_negatives.Tree(ids[order], rows[order])
    for vector in rng.integers(-50, 50, (20, 6)):
        scores = rows @ vector
        for least, most in ((-math.inf, math.inf), (100, 900), (0, 0), (-1000, int(scores[0]))):
            inside = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if least <= s <= most)[:5]
            window = hard_negatives.Window(5, least, most)
            tree.search(vector, [window])
            assert window.best == inside


def test_empty_and_huge_vectors(spark):
    assert hard_negatives.mine_negatives(vectors(spark, [])).collect() == []
    rows = [(100, [3e38], 1), (101, [3e38], 1), (200, [-3e38], 2), (102, [1e38], 3)]
    (row,) = hard_negatives.mine_negatives(vectors(spark, rows)).collect()
    assert tuple(row) == (100, 101, 1, 102, 2**63 - 1, 2**63 - 1)


# --- spelling ------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    form, n_near = {}, {}
    for word in counts:
        others = [other for other in counts if near(word, other)]
        n_near[word] = len(others)
        best = min(others, key=lambda other: (-counts[other], other), default=None)
        form[word] = best if best is not None and counts[best] >= 2 * counts[word] else None
    result = set()
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        result.add((word, form[word], root, n, n_near[word], counts[form[word]] if form[word] else None))
    return result


@pytest.mark.parametrize(("letters", "sizes"), [("ab", (1, 7)), ("abcé", (5, 8)), ("abcdefgh", (1, 4))])
@pytest.mark.parametrize("most", [1 << 14, 20])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, letters, sizes, most):
    rng, counts = random.Random(5), {}
    while len(counts) < (200 if letters == "ab" else 500):
        counts["".join(rng.choice(letters) for _ in range(rng.randint(*sizes)))] = rng.choice([1, 2, 3, 5, 8, 20, 50])
    monkeypatch.setattr(spelling.partitions, "__defaults__", (most,))
    monkeypatch.setattr(spelling, "BATCH_SYMBOLS", 300)
    found = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert len(found) == len(counts) and {tuple(r) for r in found} == plain_groups(counts)


def test_an_acceptor_is_minimal_and_numbers_its_words():
    """Equal right languages are one state, so the states are as many as distinct languages."""
    rng = random.Random(1)
    own = sorted({"".join(rng.choice("abc") for _ in range(6)) for _ in range(300)})
    symbols = np.array([[ord(c) for c in w] for w in own], dtype=np.uint32)
    acceptor = spelling.Acceptor(symbols, np.full(len(own), 6), np.array([0]))
    languages = defaultdict(set)
    for word in own:
        for k in range(7):
            languages[word[:k]].add(word[k:])
    assert len(acceptor.first) == len({frozenset(x) for x in languages.values()})
    for number, word in enumerate(own):
        state, at = acceptor.root[:1], 0
        for c in word:
            has, arc = acceptor.follow(state, np.array([ord(c)]))
            assert has[0]
            state, at = acceptor.target[arc], at + int(acceptor.before[arc][0])
        assert state[0] == 0 and at == number


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    return {word: n for word, n in counts.items() if n >= 3}


def test_words_are_those_of_the_texts(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    rows += [(None, "Straße STRASSE Größe größe GRÖßE " * 3), (None, None), (4, ""), (4, "abcde " * 3), (5, "x" * 20000 + " ")] * 2
    rows += [(6, "x" * 20000), (6, "x" * 19999 + "y")] * 3
    assert {r.word: r.n for r in spelling.vocabulary(frame(spark, rows)).collect()} == plain_vocabulary(rows)
    found = {r.word: r for r in spelling.variants_of_documents(frame(spark, rows)).collect()}
    assert found["x" * 20000].n_near == 1 and found.keys() == plain_vocabulary(rows).keys()


def test_no_words(spark):
    assert spelling.variants_of_documents(frame(spark, [])).collect() == []
    assert spelling.variants_of_documents(frame(spark, [(1, "a b"), (None, None)])).collect() == []


def test_chains_end_at_their_root(spark):
    counts = {"a" * 5 + "b" * k: 2**k for k in range(40)}
    found = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {tuple(r) for r in found} == plain_groups(counts)
    assert {r.root for r in found} == {"a" * 5 + "b" * 39}
