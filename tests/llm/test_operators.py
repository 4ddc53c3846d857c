"""The operators against plain versions, on rows with nulls, ties, copies and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import (
    bpe,
    components,
    decontaminate,
    licenses,
    line_dedup,
    line_rules,
    ngram_join,
    quality,
    queries,
    substring_dedup,
    token_counts,
    warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIMPLE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, key long, items int"


def passage(seed: int, count: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(["an", "Bé", "tion", "über", "the", "of", "x9", "Lo,", "|"]) + str(rng.randrange(60)) for _ in range(count)]


def texts() -> list[tuple[int | None, str | None]]:
    base, shared = passage(1, 200), passage(2, 40)
    near = list(base)
    near[50] = "changed"
    rows = [(10, " ".join(base)), (3, " \n".join(near)), (7, " ".join(base)), (12, "  ".join(base))]
    rows += [(20, " ".join(passage(3, 60) + shared)), (15, " ".join(shared + passage(4, 500)))]
    rows += [(1, None), (2, ""), (4, " \t\n"), (None, " ".join(base)), (None, None), (5, "one two"), (6, "One  two")]
    rows += [(8, "same line of some length here\nother\nsame line of some length here\n\n"), (9, "same line of some length hero\nOther")]
    rows += [(9, "same line of some length hero\nOther"), (30, " ".join(passage(5, 30) * 3)), (31, "x" * 3000)]
    rows += [(32, " ".join(passage(6, 4000))), (33, "MIT license, Apache  License and GENERAL public\nlicense; MIT License!")]
    rows += [(34, "Licensed under the Apache License, Version 2.0. All rights reserved <|endoftext|> 'll don't    q")]
    return rows


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", None if i == 3 else "h/p" if i and i % 2 else "h", None, "clash", 1, 2) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_encoding_equals_the_library(spark, documents, nothing):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    rows = Counter(map(tuple, bpe.round_trip_digests(documents, path).collect()))
    expected = Counter()
    for i, text in texts():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(decoded)] += 1
    assert rows == expected
    assert bpe.round_trip_digests(nothing, path).count() == 0
    counted = Counter(map(tuple, token_counts.count_tokens(documents, path, limit=100).collect()))
    assert counted == Counter(
        (i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100)
        for i, t in texts()
    )
    assert token_counts.count_tokens(nothing, path).count() == 0
    encoded = bpe.encode_texts(documents, path)
    back = bpe.decode_ids(encoded, path)
    assert back.where("not decoded <=> coalesce(text, '')").count() == 0


def test_single_pieces_equal_the_library():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library, known = Tokenizer.from_file(path), bpe.vocabulary(path)
    rng = random.Random(5)
    letters = "abcdeéüñß漢字 thing   \n\t\r019-_'sll  \u0000\u001f🙂"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
        ids = np.frombuffer(bpe.encode(path, text), dtype="<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert known.decode(ids).decode() == text


def test_license_places_and_suppression(documents, nothing):
    rows = {r.doc_id: r for r in licenses.scan(documents.where("doc_id is not null")).collect()}
    for i, text in texts():
        if i is None:
            continue
        words, places, labels = SIMPLE_WORD.findall((text or "").translate(LOWER)), [], set()
        for phrase, label in licenses.BASE.items():
            parts = phrase.split()
            for at in range(len(words)):
                if words[at : at + len(parts)] == parts:
                    places.append(at)
                    labels.add(label)
        r = rows[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    # The notice, the versioned name that overlaps it, and the reservation; what lies within them is suppressed.
    assert rows[34].labels == "apache,proprietary" and rows[34].n_detections == 3
    assert len(licenses.rules()) > 300
    assert licenses.scan(nothing).count() == 0


def license_labels(spark, texts: list[str]) -> list[set[str]]:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [set(r.labels.split(",")) for r in licenses.scan(rows).orderBy("doc_id").collect()]


def test_license_rules_need_no_other_words(spark):
    wanted = {
        "Released under Apache 2.0": "apache",
        "GNU General Public v3": "gpl",
        "under the BSD": "bsd",
        "Mozilla Public 2.0": "mpl",
        "Redistribution and use in source and binary forms, with or without modification": "bsd",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "WITHOUT WARRANTY OF ANY KIND": "disclaimer",
        "All rights reserved": "proprietary",
        "in the public domain": "public-domain",
        "CC_BY 4.0": "cc-by",
        "Creative Commons Attribution": "cc-by",
    }
    for space in (" ", "\n", "\r\n * "):
        found = license_labels(spark, [text.replace(" ", space) for text in wanted])
        assert [label in labels for label, labels in zip(wanted.values(), found, strict=True)] == [True] * len(wanted)


def examples(parsed) -> list[str]:
    """Texts of a parsed pattern that have each of its alternatives at least once."""
    parts = []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            least = value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0]
            parts.append([chr(least)])
        elif name == "MAX_REPEAT":
            parts.append((["", *examples(value[2])] if value[0] == 0 else [t * value[0] for t in examples(value[2])]))
        elif name == "SUBPATTERN":
            parts.append(examples(value[-1]))
        else:
            assert name == "BRANCH", name
            parts.append([t for branch in value[1] for t in examples(branch)])
    return ["".join(p[i % len(p)] for p in parts) for i in range(max(map(len, parts), default=1))]


def test_each_license_rule_has_a_keyword_in_any_match(spark):
    wanted = {
        "Distributed under the Expat License": "mit",
        "X11 license": "mit",
        "Common Development and Distribution License 1.0": "cddl",
        "PSF license": "python",
        "Commercial license": "proprietary",
    }
    for text, labels in zip(wanted, license_labels(spark, list(wanted)), strict=True):
        assert labels == {wanted[text]}
    alone = 0
    for keywords, pattern, *_ in licenses.rules():
        for text in examples(re._parser.parse(pattern)):
            assert re.fullmatch(pattern, text), (pattern, text)
            assert set(keywords.split("|")) & set(text.split(" ")), (keywords, text)
            alone += 1
    assert alone > 1000


def test_lines_within_one_edit_go(spark, documents, nothing):
    rows = line_dedup.drop_lines(documents).collect()
    got = {(r.doc_id, r.text) for r in rows}
    assert len(rows) == documents.count() and set(rows[0].asDict()) >= set(documents.columns)
    assert (8, "same line of some length here\nother\n\n") in got
    assert (9, "Other") in got
    assert sum(r.doc_id == 12 and r.text == "" and r.emptied for r in rows) == 0  # other white space is another line
    assert any(r.doc_id == 10 and r.emptied for r in rows) and any(r.doc_id == 1 and r.text is None for r in rows)
    assert line_dedup.drop_lines(nothing).count() == 0
    rng = random.Random(3)
    lines = []
    for _ in range(60):
        line = "".join(rng.choice("abé") for _ in range(rng.randrange(19, 27)))
        lines.append(line)
        for _ in range(3):
            at, how = rng.randrange(len(line)), rng.randrange(3)
            line = line[:at] + ("" if how == 0 else rng.choice("abé")) + line[at + (how != 1) :]
            lines.append(line)
    rng.shuffle(lines)
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.drop_lines(frame).where("emptied").collect()}
    expected = {
        i
        for i, a in enumerate(lines)
        if any(a == b or (min(len(a), len(b)) >= line_dedup.LEAST_NEAR and edits(a, b) <= 1) for b in lines[:i])
    }
    assert gone == expected


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_quality_tells_junk_and_shrinks_sparse_sites(spark, nothing):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = passage(i + 100, rng.randrange(40, 200))
        text = "!! ".join(w.upper() for w in words) if bad else " ".join(words)
        rows.append((i, text, "en", f"s{i % 3}" if i < 590 else f"rare{i}"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not bad)))
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels[: len(labels) // 2] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.Classifier(documents, known).scores().collect()}
    held_out = labels[len(labels) // 2 :]
    assert sum(found[i].kept == bool(good) for i, good in held_out) >= 0.97 * len(held_out)
    shares = [found[i].path_share for i in range(590, 600)]
    assert max(shares) - min(shares) < 0.5
    kept = quality.Classifier(documents, known).keep_good(documents)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {
        i for i, r in found.items() if r.kept
    }
    odd = spark.createDataFrame([(None, None, None, None), (1, "", None, "a/b"), (1, "", None, "a/b")], documents.schema)
    assert quality.Classifier(odd, known.where("false")).scores().where("kept").count() == 3
    assert quality.Classifier(nothing, known).scores().count() == 0


def test_line_rules(spark, documents, nothing):
    rows = line_rules.judge(documents).collect()
    expected = Counter()
    for i, text in texts():
        words = WORD.findall(text or "")
        runs = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        mask = [0] * len(words)
        for k in range(len(words) - 7):
            if runs[tuple(words[k : k + 8])] > 1:
                mask[k : k + 8] = [1] * 8
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        failed = len(words) < 20 or 100 * sum(mask) > 30 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        expected[i, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), sum(mask), failed] += 1
    assert Counter(tuple(r)[:7] for r in rows) == expected
    assert not any(r.kept and r.base_failed for r in rows)
    assert line_rules.judge(nothing).count() == 0
    filler = "the same words stand in every footer of this host and nobody reads them at all here again"
    site = [(i, filler + "\n" + " ".join(passage(i, 4)), "a") for i in range(12)]
    site += [(99, filler + " " + filler.upper(), "b"), (100, filler + "\n" + " ".join(passage(77, 200)), "a")]
    judged = {r.doc_id: r.kept for r in line_rules.judge(spark.createDataFrame(site, "doc_id long, text string, source string")).collect()}
    assert not any(judged[i] for i in range(12)) and judged[99] and judged[100]


def test_archives_are_read_back(spark, nothing):
    same = "é" * 60
    rows = [(5, "u", same), (2, "u\r\nv", same), (9, None, same), (1, "a", "short"), (3, "b", "short"), (4, None, None), (6, "c", "")]
    rows += [(7, "d", "line\r\n\r\nWARC/1.1\r\n" * 9), (None, "e", same), (8, "f", "y" * 300_000), (2, "u", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload))
        for r in warc.archive_pages(pages).collect()
    )
    expected = Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = html == same and page not in (2, None)
        expected[page, len(body), sha(body), "revisit" if revisit else "response", 2 if revisit else None, b"" if revisit else body] += 1
    assert found == expected
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_benchmark_passages(spark, documents, nothing, monkeypatch):
    items = [(1, " ".join(passage(2, 40))), (2, "One, TWO"), (3, None), (4, "..."), (None, "one two"), (10, "public"), (11, " ".join(passage(2, 40)[5:20]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = Counter(map(tuple, decontaminate.judge(documents, benchmark).collect()))
    expected = Counter()
    for i, text in texts():
        words, hit, names = SIMPLE_WORD.findall((text or "").translate(LOWER)), set(), set()
        for item, other in items:
            own = SIMPLE_WORD.findall((other or "").translate(LOWER)) if item is not None else []
            size = min(13, len(own))
            windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            for k in range(len(words) - size + 1 if windows else 0):
                if tuple(words[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    names.add(item)
        ids = sha(",".join(sorted(map(str, names))))
        expected[i, len(words), len(hit), len(names), ids, len(hit) > 0 and 20 * len(hit) >= len(words)] += 1
    assert rows == expected
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 10)
    assert Counter(map(tuple, decontaminate.judge(documents, benchmark).collect())) == expected
    assert decontaminate.judge(documents, benchmark.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.judge(nothing, benchmark).count() == 0


def test_repeated_windows(documents, nothing):
    rows = Counter(tuple(r)[:4] for r in substring_dedup.remove_repeats(documents).collect())
    first: dict[tuple, int] = {}
    for i, text in sorted((x for x in texts() if x[0] is not None), key=lambda x: x[0]):
        words = WORD.findall(text or "")
        for k in range(len(words) - 12):
            first.setdefault(tuple(words[k : k + 13]), i)
    expected = Counter()
    for i, text in texts():
        words = WORD.findall(text or "")
        mask = [False] * len(words)
        for k in range(len(words) - 12):
            if i is not None and first[tuple(words[k : k + 13])] < i:
                mask[k : k + 13] = [True] * 13
        kept = " ".join(w for w, gone in zip(words, mask, strict=True) if not gone)
        expected[i, len(words), sum(mask), sha(kept)] += 1
    assert rows == expected
    assert substring_dedup.remove_repeats(nothing).count() == 0


def linked_components(rows: list[tuple[int | None, str | None]]) -> Counter:
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[k : k + 4]) for k in range(len(words) - 3)} or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def test_linked_documents(spark, documents, nothing, monkeypatch):
    assert Counter(map(tuple, ngram_join.join_documents(documents).collect())) == linked_components(texts())
    assert ngram_join.join_documents(nothing).count() == 0
    rng, rows = random.Random(4), []
    for size in (5, 9, 30, 90, 300):
        base = passage(size, size)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + size // 18)):
                copy[rng.randrange(size)] = str(rng.random())
            rows.append((len(rows), " ".join(copy[: size - rng.randrange(0, 1 + size // 15)])))
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = ngram_join.join_documents(frame)
    expected = linked_components(rows)
    assert Counter(map(tuple, found.collect())) == expected
    kept = ngram_join.keep_first(frame)
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c for _, _, c in expected})


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_extra_columns_stay_apart(documents):
    wide = documents.withColumn("text_hash", F.lit("x")).withColumn("gone_id", F.lit(1)).withColumn("path_share", F.lit(2))
    assert ngram_join.keep_first(wide).columns == wide.columns
    assert decontaminate.find_passages(wide, documents.selectExpr("doc_id AS item_id", "text")).count() == wide.count()


def test_blocks_of_a_large_component_meet_by_size(spark, monkeypatch):
    """Every two classes whose sizes may link meet in a pair of blocks; most blocks need not meet."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rule = ngram_join.Rule(5, 80)
    sizes = {k: 1 + int(1.05**k) for k in range(160)} | {1000: 3, 1001: 900}
    rows = [(k, 7 if k < 1000 else 8, n) for k, n in sizes.items()]
    sized = spark.createDataFrame(rows, "class long, root long, n_grams long")
    found = {r["class"]: (r.root, r.block, set(r.others)) for r in ngram_join.places(sized, rule).collect()}
    assert set(found) == set(sizes)
    for a, (root, block, others) in found.items():
        assert block in others
        for b, (root_b, block_b, others_b) in found.items():
            if root == root_b and 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b]):
                assert block_b in others and block in others_b
    blocks = {block for root, block, _ in found.values() if root == 7}
    assert sum(len(others) for root, _, others in found.values() if root == 7) < 160 * len(blocks) / 3
    assert found[1000][1] == found[1001][1] == 0
