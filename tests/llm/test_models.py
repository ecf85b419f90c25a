"""Classifier chain, line labelling and language model: held-out accuracy and brute force."""

import collections
import math
import re

import numpy as np
import pytest

from vacantia.llm import crf, katz, toxicity, words

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, toxic string, n_words string"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_chain_held_out_in_every_language(spark, frame):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    chain = toxicity.train(docs.where("doc_id % 2 = 0"), labels)
    assert chain.names == ["kind_1", "kind_2", "kind_3", "toxic"]
    told = docs.where("doc_id % 2 = 1").select("doc_id", "lang").join(labels.withColumnRenamed("toxic", "truth"), "doc_id")
    rows = toxicity.score(docs.where("doc_id % 2 = 1"), chain).join(told, "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic, clean = ([r["toxic"] for r in rows if r["lang"] == lang and r["truth"] == t] for t in (1, 0))
        assert len(toxic) >= 8 and sum(toxic) >= 0.85 * len(toxic)  # two of the Spanish ones hold nothing toxic
        assert sum(clean) <= 0.01 * len(clean)


def test_scores_against_a_plain_chain(spark, tables):
    docs, labels = tables
    chain = toxicity.train(docs, labels)
    place = {int(p): i for i, p in enumerate(chain.features)}
    for r in toxicity.score(docs.limit(40), chain).join(docs, "doc_id").collect():
        x = np.zeros(len(chain.features))
        for word in re.findall(rb"[a-z0-9\x80-\xff]+", toxicity.folded(np.frombuffer(r["text"].encode(), np.uint8)).tobytes()):
            for n in toxicity.LENGTHS:
                for i in range(len(word) + 3 - n):
                    x[[place[h] for h in [plain_place((b" " + word + b" ")[i:i + n])] if h in place]] += 1
        x = np.log1p(100 * x / max(len(r["text"].split()), 1))
        before = []
        for name, w in zip(chain.names, chain.weights):
            z = sum(w[:len(x)] * x) + sum(a * b for a, b in zip(w[len(x):-1], before)) + w[-1]
            before.append(1 / (1 + math.exp(-z)))
            assert r[f"p_{name}"] == pytest.approx(before[-1], abs=1e-9)
        assert r["toxic"] == (before[-1] > 0.5)


def plain_place(gram):
    word = (1 << 32) - 1
    h = gram[0] * 0x9E3779B1 & word
    for c in gram[1:]:
        h = (h * 0x01000193 & word) ^ (c * 0x85EBCA6B & word)
    h ^= h >> 15
    h = h * 0x2C1B3C6D & word
    return (h ^ h >> 13) >> 32 - toxicity.BITS


def test_segments_do_not_change_the_features(monkeypatch):
    texts = [b"", "Ein GR\u00dcNER Satz, ab".encode(), b"x", b"alpha beta" * 20, b""]
    whole = sorted(zip(*(v.tolist() for v in toxicity._places(texts))))
    monkeypatch.setattr(toxicity, "SEGMENT", 7)
    assert sorted(zip(*(v.tolist() for v in toxicity._places(texts)))) == whole
    assert {d for d, _ in whole} == {1, 2, 3}  # one letter with its edges is an n-gram of three


def test_later_links_use_earlier_ones_and_given_categories(frame):
    rng = np.random.default_rng(0)
    x = (rng.random((300, 6)) < 0.2).astype(float)
    toxic = np.arange(300) % 3 == 0
    x[:, 2] = toxic
    links = np.stack([toxic, np.zeros(300), toxic], axis=1).astype(float)
    chain = toxicity.fit_chain(np.arange(6), x, links, ["a", "b", "toxic"], np.arange(300) % 5, np.ones(300))
    assert [len(w) for w in chain.weights] == [7, 8, 9]
    p = chain.probabilities(np.array([[0, 0, 1.0, 0, 0, 0], [0.0] * 6]))
    assert p[0, -1] > 0.9 and p[1, -1] < 0.1 and p[0, 0] > 0.9 and p[0, 1] < 0.1
    rows = [(i, ("vile thing " if i % 2 else "kind thing ") + f"w{i} v{i}", "", "") for i in range(60)]
    labels = frame([(i, 1, i % 2, "", i % 2 if i else None) for i in range(60)], LABELS + ", insult int")
    got = toxicity.classify(frame(rows, SCHEMA), labels, categories=["insult"]).collect()
    assert all(r["toxic"] == bool(r["doc_id"] % 2) == (r["p_insult"] > 0.5) for r in got)


def test_chain_edge_cases(spark, frame):
    docs = frame([(1, None, "", ""), (2, "", "", ""), (None, "idiot", "", ""), (4, "x " * 5000, "", ""), (4, "x " * 5000, "", "")], SCHEMA)
    for labels in (frame([], LABELS), frame([(1, 1, None, ""), (None, 0, 1, ""), (2, 0, 1, ""), (2, 0, 0, "")], LABELS)):
        got = toxicity.classify(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r["p_toxic"] <= 1 for r in got)
        assert toxicity.drop_toxic(docs, labels).columns == docs.columns
        assert toxicity.classify(frame([], SCHEMA), labels).collect() == []


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def test_lines(spark, frame, tables):
    docs, labels = tables
    model = crf.train(docs, labels)
    extra = frame([(-1, None), (-2, ""), (-3, "\n\n"), (None, "a b c a b c\na\na\n\r\x0b x é|$"), (-5, "good words " * 40), (-5, "good words " * 40)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    got = crf.label_lines(rows, model).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = [(r["doc_id"], *plain_base(r["text"] or "")) for r in rows.collect()]
    assert sorted(map(str, ((r["doc_id"], *(r[f] for f in fields)) for r in got))) == sorted(map(str, expected))
    assert not any(r["kept"] for r in got if r["base_failed"])
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    passed = [r for r in got if r["doc_id"] in truth and not r["base_failed"]]
    assert sum(r["kept"] == bool(truth[r["doc_id"]]) for r in passed) >= 0.95 * len(passed)
    assert crf.label_lines(frame([], SCHEMA), model).collect() == []
    untrained = crf.train(docs, frame([], LABELS))
    assert all(r["kept"] != r["base_failed"] for r in crf.label_lines(docs, untrained).collect())


def test_viterbi_and_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    features = rng.random((9, 3)) > 0.5
    first = np.array([0, 4, 4, 9])
    model = crf.Crf(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    labels = crf.viterbi(model, features, first)
    marginal, pairs, _ = crf._expectations(model, features.astype(float), first)
    total = np.zeros((2, 2))
    for a, b in ((0, 4), (4, 9)):
        best, weights = None, []
        for code in range(1 << (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            s = model.start[y[0]] + sum(features[a + i] @ model.emission[:, v] for i, v in enumerate(y))
            s += sum(model.transition[u, v] for u, v in zip(y, y[1:]))
            weights.append((s, y))
            best = max(best or (s, y), (s, y))
        assert labels[a:b].tolist() == best[1]
        z = sum(math.exp(s) for s, _ in weights)
        for i in range(b - a):
            assert marginal[a + i, 1] == pytest.approx(sum(math.exp(s) for s, y in weights if y[i]) / z)
        for s, y in weights:
            for u, v in zip(y, y[1:]):
                total[u, v] += math.exp(s) / z
    assert pairs == pytest.approx(total)


@pytest.mark.parametrize("hot", [0, 64])
def test_katz_against_plain_counts(spark, frame, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(frame([(None, "a b c"), (-1, None), (-2, ""), (-5, " zz yy THE the"), (-5, " zz yy THE the")], "doc_id long, text string"))
    got = katz.katz_scores(docs, sample_documents=100).collect()
    texts = [(r["doc_id"], [w.decode() for w in (r["text"] or "").encode().lower().split()] + ["</s>"]) for r in docs.collect()]
    train = [w for i, w in texts if not katz.is_held(i)]
    count = collections.Counter(w for x in train for w in x)
    pairs = collections.Counter(p for x in train for p in zip(["</s>", *x], x))
    tally = lambda c: [sum(v == k for v in c.values()) for k in range(1, katz.LARGE + 2)]
    of_pair, of_word = katz.discounted(tally(pairs)), katz.discounted(tally(count))
    d = lambda n, table: table[n - 1] if n <= katz.LARGE else n
    n_train, distinct = sum(count.values()), len(count)
    word = {w: d(n, of_word) / (n_train + 1) for w, n in count.items()}
    unknown = 1 - sum(word.values())
    after = collections.defaultdict(dict)
    for (h, w), n in pairs.items():
        after[h][w] = n
    alpha = {h: (1 - sum(d(n, of_pair) for n in x.values()) / (count[h] + 1)) / (1 - sum(word[w] for w in x)) for h, x in after.items()}
    for h in list(after)[:50]:
        mass = sum(d(n, of_pair) / (count[h] + 1) for n in after[h].values()) + alpha[h] * (unknown + sum(p for w, p in word.items() if w not in after[h]))
        assert mass == pytest.approx(1)
    expected = []
    for i, x in texts:
        base = sum(math.log10((count[w] + 1) / (n_train + distinct + 1)) for w in x)
        score = 0.0
        for h, w in zip(["</s>", *x], x):
            n = after.get(h, {}).get(w, 0)
            score += math.log10(d(n, of_pair) / (count[h] + 1)) if n else math.log10(alpha.get(h, 1) * word.get(w, unknown))
        expected.append((str(i), katz.is_held(i), len(x), sum(count[w] > 0 for w in x), n_train, base, score))
    assert len(got) == len(expected)
    for a, b in zip(sorted((str(r[0]), *r[1:]) for r in got), sorted(expected)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)
    assert katz.katz_scores(frame([], SCHEMA)).collect() == []
    lone = katz.katz_scores(frame([(16, "a b", "", "")], SCHEMA)).collect()  # one held-out row: nothing to learn from
    assert len(lone) == 1


def test_dealing_to_more_groups_than_a_shift_holds():
    rng = np.random.default_rng(2)
    group = rng.integers((1 << 20) - 500, (1 << 20) + 5000, 20_000).astype(np.uint64)
    path = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    order, runs = words.dealt(group, path)
    assert [g for g, _, _ in runs] == sorted(set(group.tolist())) and runs[0][1] == 0 and runs[-1][2] == 20_000
    for g, a, b in runs:
        own = order[a:b]
        assert (group[own] == g).all() and (np.diff(path[own].astype(float)) >= 0).all()
    assert words.dealt(group[:0], path[:0])[1] == []
