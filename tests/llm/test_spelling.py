"""Spelling variants against brute force over all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vacantia.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, near string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, varied=31):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if varied and h % varied == 0 else run] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in known if one_edit(w, x)] for w in known}
    best = {w: min(near[w], key=lambda x: (-known[x], x), default=None) for w in known}
    form = {w: b if b and known[b] >= 10 * known[w] else None for w, b in best.items()}
    out = []
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], known[form[w]] if form[w] else None, root))
    return sorted(out)


def found(docs, **options):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(docs, **options).collect())


def rows_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_words_of_given_documents(spark, frame, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    long = "a" * 80
    docs = docs.unionByName(frame([(None, "Spelling spellling spelling"), (None, "spelling"), (1, None), (2, ""), (3, "ÀÉéßÿ×÷ab ÀÉéßÿ×÷ab ÀÉéßÿ×÷ac ÀÉéßÿ×÷ac"),
                                   (4, f"{long} {long} {long}b {long}b {long}bb {long}bb b{long} b{long}")], "doc_id long, text string"))
    assert found(docs) == plain(rows_of(docs))
    monkeypatch.setattr(spelling, "SEGMENT", 50)
    assert [tuple(r) for r in spelling.vocabulary(docs).orderBy("word").select("word", "n").collect()] == [r[:2] for r in plain(rows_of(docs))]


def test_chains_ties_and_several_rounds(frame, monkeypatch):
    text = "alphabeta " * 1000 + "alphabetaa " * 100 + "alphabetaax " * 10 + "alphabetaaxx " + "gammadelta gammadeltb gammadeltc " * 20 + "gammadeltd " * 2
    docs = frame([(1, text, "x", 1, "y"), (1, text, "x", 1, "y")], SCHEMA)
    expected = plain(rows_of(docs), 0)
    assert found(docs, varied=0) == expected
    assert {r[0]: r[5] for r in expected}["alphabetaaxx"] == "alphabeta"
    assert {r[0]: r[3] for r in expected}["gammadeltd"] == "gammadelta"
    monkeypatch.setattr(spelling, "PIECE", 1)
    assert found(docs, varied=0, filter_bytes=64) == expected


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 9)) for _ in range(3000)]
    coded = spelling._coded(words, 9)
    hashes = (spelling._VALUES[coded] * spelling._powers(9)).sum(axis=1, dtype=np.uint64)
    blocks = len(words) * spelling.BITS_PER_WORD // 512
    mixed = spelling.mix(hashes)
    bits = np.zeros((blocks, 8), np.uint64)
    for i in range(spelling.HASHES):
        bit = spelling._bit(spelling.mix(mixed), i)
        np.bitwise_or.at(bits, (spelling._block(mixed, blocks).astype(int), (bit >> np.uint64(6)).astype(int)), np.uint64(1) << (bit & np.uint64(63)))
    tested = spelling.Filter(blocks, 0, bits.ravel())
    assert len(tested.passes(hashes)) == len(hashes)
    assert len(tested.passes(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64))) < 1000
    near = {(words[w], "".join(words[w][:p] + spelling.LETTERS[c] + words[w][p + 1:])) for w, place, letter in spelling._edits(
        coded, {9: tested}, np.arange(10)) for w, p, c in zip(w, place, letter) if c >= 0}
    assert {(a, b) for a in words[:300] for b in words if one_edit(a, b) and a < b} <= near


@pytest.mark.parametrize("rows", [[], [(1, None, "x", 2, "y")], [(1, "too short and once only", None, None, None)]])
def test_no_words(frame, rows):
    assert found(frame(rows, SCHEMA)) == []
