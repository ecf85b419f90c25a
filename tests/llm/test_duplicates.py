"""Suffix trees, Order MinHash and benchmark search against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from vacantia.llm import components, decontaminate, order_minhash, suffix_trees, words

SCHEMA = "doc_id long, text string, id string, token string"
LEAST = -(1 << 63)


def plain_removal(rows):
    first = {}
    for key, text in sorted(rows, key=lambda r: LEAST if r[0] is None else r[0]):
        k = LEAST if key is None else key
        for s in range(len(text) - 19):
            first.setdefault(tuple(text[s:s + 20]), (k, s))
    out = []
    for key, text in rows:
        k, gone = LEAST if key is None else key, set()
        for s in range(len(text) - 19):
            if first[tuple(text[s:s + 20])] < (k, s):
                gone |= set(range(s, s + 20))
        kept = b" ".join(w for i, w in enumerate(text) if i not in gone)
        out.append((str(key), len(text), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"sample_documents": 20}, {"group_suffixes": 4000}])
def test_removal(spark, frame, options):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    line = " ".join(f"w{i}" for i in range(30))
    hot = [(1000 + i, f"own{i} {line} tail{i}") for i in range(40)]
    docs = docs.unionByName(frame([(None, line), (-1, None), (-2, ""), (-5, line + " x " + line), (-5, line + " x " + line),
                                   (-6, "a " * 50), (5000, "long " * 20000 + line), *hot], "doc_id long, text string"))
    got = suffix_trees.remove_repeats(docs, **options).collect()
    assert sorted((str(r[0]), *r[1:4]) for r in got) == plain_removal([(r["doc_id"], (r["text"] or "").encode().split()) for r in docs.collect()])
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_removal_edge_cases(spark, frame):
    assert suffix_trees.remove_repeats(frame([], SCHEMA)).collect() == []
    got = suffix_trees.remove_repeats(frame([(1, "a b", "x", "y"), (None, None, "x", "y")], SCHEMA)).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(0, 0), (2, 0)]
    assert suffix_trees.spans(np.array([3, 4, 30, 60]), 20) == [(3, 24), (30, 50), (60, 80)]


def test_alignment_keeps_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 25))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        runs = order_minhash.edit_path(a, b, 60)
        assert sum(r[2] for r in runs) == row[-1]
        assert all(a[i:i + k] == b[j:j + k] for i, j, k in runs)
    assert order_minhash.edit_path([1] * 50, [2] * 50, 20) is None


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    base = [f"v{rng.randint(0, 10**6)}" for _ in range(400)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(len(own))] = f"n{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_classes(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    group = near_copies(1, 60, 3)
    extra = [(2000 + i, t) for i, t in enumerate(group)] + [(3000 + i, group[0]) for i in range(30)]
    extra += [(4000, None), (4001, ""), (4002, "a b"), (4003, "a b"), (4004, "b a"), (None, "a b"), (4005, "x y z w v"), (4005, "x y z w v")]
    docs = docs.unionByName(frame(extra, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] is not None]
    value = {t: words.word_arrays(t.encode())[2] for _, t in rows}
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shingle = {t: set(order_minhash.shingles(v).tolist()) for t, v in value.items()}
    holders = collections.defaultdict(set)
    for t, s in shingle.items():
        for x in s:
            holders[x].add(t)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    linked = [(a, b) for a, b in pairs if order_minhash.similar(value[a], value[b]) >= 0.8]
    by_text = collections.defaultdict(list)
    for k, t in rows:
        by_text[t].append(k)
    for own in [*by_text.values(), *([by_text[a][0], by_text[b][0]] for a, b in linked)]:
        for k in own[1:]:
            x, y = find(own[0]), find(k)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in order_minhash.near_duplicates(docs).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == {k: find(k) for k, _ in rows}
    sizes = collections.Counter(find(k) for k in got)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got.values())
    assert sizes[2000] == 90 and got[4004]["class_size"] == 1
    kept = order_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted({r["doc_id"] for r in kept.collect()} - {None}, key=int) == sorted(sizes)


def test_classes_need_more_than_the_first_star(spark, frame):
    """Members unlike the centre of their bucket, but like each other, still meet."""
    a, b = near_copies(5, 1, 0)[0].split(), near_copies(6, 1, 0)[0].split()
    rng = random.Random(2)
    texts = []
    for k in range(12):  # each keeps most of its predecessor: a chain from a to b
        mixed = [y if i < k * 34 else x for i, (x, y) in enumerate(zip(a, b))]
        texts.append(" ".join(mixed))
    order = list(range(12))
    rng.shuffle(order)
    docs = frame([(10 + n, texts[k], "", "") for n, k in enumerate(order)], SCHEMA)
    assert {r["class_id"] for r in order_minhash.near_duplicates(docs).collect()} == {10}


def short_families(seed, sizes):
    """Families of a text and its copies with words appended, taken away or changed, a few words of each known to all."""
    rng, out = random.Random(seed), []
    line = [f"line{i}" for i in range(7)]
    for size in sizes:
        base = [f"s{size}x{i}" for i in range(size)]
        common = line + base[7:] if size > 8 and size % 3 == 0 else base
        one = rng.randrange(size)
        own = [base, base + ["more"], base + ["one", "two"], base[:-1] + ["last"], base[2:], base[:one] + ["new"] + base[one + 1:],
               common, common + ["end"], common[:-1] + ["other"], base[:one] + ["put"] + base[one:]]
        out += [" ".join(x) for x in own]
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("hot", [100, 3])
def test_short_classes_are_exact(spark, frame, monkeypatch, hot):
    """Every pair of short texts that brute force links is found, also where few shingles make the tuples unequal."""
    monkeypatch.setattr(order_minhash, "HOT", hot)
    texts = short_families(4, [*range(5, 27), 44, 49, 57, 60, 61, 64, 72, 74])
    random.Random(3).shuffle(texts)
    value = [words.word_arrays(t.encode())[2] for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if least[i] != least[j] and order_minhash.similar(value[i], value[j]) >= 0.8:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    docs = frame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    assert {i: c for i, c in enumerate(least) if got[i] != c} == {} and len(got) == len(texts)


def test_parities_never_rule_out_a_similar_pair():
    rng = random.Random(12)
    for size in (5, 40, 300, 4000):
        a = np.array([rng.randrange(size) for _ in range(size)], np.uint64)
        b = np.delete(a, rng.sample(range(size), size // 20 + 1))
        x, y = (order_minhash.labelled(order_minhash.shingles(words.mix(v))) for v in (a, b))
        bits = sum(int(v).bit_count() for v in (order_minhash.parities(x) ^ order_minhash.parities(y)).view(np.uint64))
        assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_pairs_by_blocks_and_shuffle_joins(spark, frame, monkeypatch):
    """Buckets cut into blocks, no star repeated and nothing broadcast: the same links between components."""
    for name, value in (("PAIR_BLOCK", 3), ("STAR_ROUNDS", 0), ("BROADCAST_IDS", 0), ("BROADCAST_SKETCHES", 0)):
        monkeypatch.setattr(order_minhash, name, value)
    texts = [t for seed in range(20, 25) for t in near_copies(seed, 6, 2)]
    members = frame([(token, i, len(t.split()), 0) for token in (7, 8) for i, t in enumerate(texts)], "token long, id long, n long, u long")
    links = order_minhash.similar_links(members, frame(list(enumerate(texts)), "id long, text string"), len(texts), 0.8)
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    value = [words.word_arrays(t.encode())[2] for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if least[i] != least[j] and order_minhash.similar(value[i], value[j]) >= 0.8:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    assert len(set(least)) < len(texts) and [got.get(i, i) for i in range(len(texts))] == least


@pytest.mark.parametrize("hot", [100, 2])
def test_prefix_tokens_meet(spark, frame, monkeypatch, hot):
    monkeypatch.setattr(order_minhash, "HOT", hot)
    rng, sets = random.Random(8), []
    for k in range(120):
        base = rng.sample(range(80), rng.randint(1, 40))
        sets += [base, *([x for x in base if rng.random() > 0.1] + rng.sample(range(80, 120), rng.randint(0, 2)) for _ in range(2))]
    rows = [(i, len(x) + 4, sorted(set(x))) for i, x in enumerate(sets) if x]
    got = {r["id"]: set(r["tokens"]) for r in order_minhash.prefix_tokens(frame(rows, "id long, n long, short array<long>"), 0.8).collect()}
    pairs = [(i, j) for i, _, x in rows for j, _, y in rows if j < i and 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})]
    assert len(pairs) > 100 and all(got[i] & got[j] for i, j in pairs)


def test_one_common_tuple_is_enough(spark, frame):
    """Two members of a bucket that its centre does not join are compared, though they share no other bucket."""
    texts = [" ".join(f"c{i}" for i in range(90)), *near_copies(9, 2, 1)]
    members = frame([(7, i, len(t.split()), 0) for i, t in enumerate(texts)], "token long, id long, n long, u long")
    links = order_minhash.similar_links(members, frame(list(enumerate(texts)), "id long, text string"), len(texts), 0.8)
    assert [sorted(r) for r in links.collect()] == [[1, 2]]


def test_empty_and_odd_columns(spark, frame):
    assert order_minhash.near_duplicates(frame([], SCHEMA)).collect() == []
    got = order_minhash.near_duplicates(frame([(1, "a", "q", "q")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1)]


def test_components(spark, frame):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randint(300, 600), rng.randint(300, 600)) for _ in range(150)]
    links += [(None, 4), (7, 7), (0, 1)]
    got = {r["node"]: r["component"] for r in components.components(frame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p if x is not None}
    for _ in range(700):
        for x, y in links:
            if x is not None:
                parent[x] = parent[y] = min(parent[x], parent[y])
    assert got == {k: v for k, v in parent.items() if k in got} and set(parent) - {7} <= set(got) | {7}


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, e in enumerate(text):
            new.append(min(row[j] + (c != e), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_and_pieces():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        d = plain_distance(p, t)
        assert decontaminate.best_end(len(p), decontaminate.masks(p), t)[0] == d
        for k in range(min(4, len(p))):
            hits = decontaminate.PieceFinder([(0, p)], k / len(p) + 1e-9).find(t)
            assert bool(hits) == (d <= k) and (not hits or hits[0][1] == d)


@pytest.mark.parametrize("options", [{}, {"block_chars": 60}])
def test_decontamination(spark, frame, options):
    items = frame([(1, "The quick brown fox jumps over the lazy dog near a river"), (2, "short one"), (3, None), (None, "lost item"),
                   (4, "!!!"), (5, "The quick brown fox jumps over the lazy dog near a river")], "item_id long, text string")
    docs = frame([
        (1, "Well: the QUICK, brown fox -- jumps over the lazy dog\nnear a river!", "", ""), (2, "the quick brwn fox jumps over the lazy dogs near a river", "", ""),
        (3, "the quick brown cat jumps over a lazy hog far from a river", "", ""), (4, None, "", ""), (5, "", "", ""),
        (None, "x " * 3000 + "short one", "", ""), (7, "x " * 9000 + "short one", "", ""), (7, "x " * 9000 + "short one", "", ""),
    ], SCHEMA)
    got = sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in decontaminate.find_items(docs, items, **options).collect())
    assert got == [("1", 1, 0), ("1", 5, 0), ("2", 1, 2), ("2", 5, 2), ("7", 2, 0), ("7", 2, 0), ("None", 2, 0)]
    kept = decontaminate.drop_contaminated(docs, items, **options)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.find_items(frame([], SCHEMA), items).collect() == []
    assert decontaminate.find_items(docs, items.limit(0)).collect() == []
