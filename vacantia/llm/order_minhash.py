"""Near-duplicates by Order MinHash with banded alignment.

A sketch holds BANDS tuples: for each hash function the LEAST occurrence-labelled five-word shingles of smallest hash,
kept in text order.  Two texts with a tuple in common are candidates; they are linked if an alignment of their words
inside a band keeps at least 0.8 of their shingles.  Exact copies are collapsed first.  A pair of similarity s has a tuple
in common with chance s**LEAST for long texts, so at 0.8 one pair in some 127,000 has none of 64, and one in some 31,000
where the shorter has just over 60 words.

Tuples fail texts of few shingles, so a pair whose shorter text has up to SHORT shingles is found exactly: such texts hold
the rarest of their shingles instead (`prefix_tokens`), and one in common makes a candidate.

Large groups never become pairs: each bucket compares its members with one centre (a star, salted), stars repeat with other
centres for members that did not join, and only what then still lies in different components is compared pairwise, so
no link between two members of a bucket is lost.  There, bitmaps of parities rule out most pairs before they become rows:
two texts differ in at least as many shingles as their bitmaps differ in bits, so no similar pair is ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import words
from vacantia.llm.components import components
from vacantia.llm.shared import written

SHINGLE = 5
BANDS = 64
LEAST = 8
SIMILARITY = 0.8
STAR_ROUNDS = 6
BROADCAST_IDS = 300_000
SHORT = 56  # shingles, so 60 words
HOT = 100  # short texts with one shingle, beyond which its bucket is split by their sizes
BROADCAST_SKETCHES = 50_000  # half a KB each, seldom more
SALT_ROWS = 64
PAIR_SALTS = 8  # the last pairs have many first texts with fewer partners each
PARITY_WORDS = 16  # longs of a parity bitmap
PAIR_BLOCK = 2048  # first texts of one bucket that one group compares with all of its members
_RANDOM = np.random.default_rng(20240101)
_MULTIPLY = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the five-word windows; a shorter text is one shingle of all its words."""
    return words.window_hashes(hashes, SHINGLE if len(hashes) >= SHINGLE else max(len(hashes), 1))


def labelled(values: np.ndarray) -> np.ndarray:
    """Values made distinct by how often each occurred before."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(values) else np.zeros(0, bool)
    at = np.arange(len(values))
    count = at - np.maximum.accumulate(np.where(new, at, 0)) if len(values) else at
    out = np.empty_like(values)
    out[order] = np.where(new, ranked, words.mix(ranked + count.astype(np.uint64)))
    return out


def sketch(values: np.ndarray, bands: int = BANDS, least: int = LEAST) -> np.ndarray:
    """One 64-bit value per band: the chosen shingles in text order."""
    out = np.zeros(bands, np.uint64)
    if not len(values):
        return out
    k = min(least, len(values))
    group = max(1, (1 << 18) // len(values))
    for a in range(0, bands, group):
        b = min(bands, a + group)
        ranked = (values[None, :] ^ _FLIP[a:b, None]) * _MULTIPLY[a:b, None]
        place = np.argpartition(ranked, k - 1, axis=1)[:, :k] if k < len(values) else np.tile(np.arange(k), (b - a, 1))
        chosen = values[np.sort(place, axis=1)]
        value = np.arange(a + 1, b + 1, dtype=np.uint64)
        for j in range(k):
            value = words.mix(value * np.uint64(31) + chosen[:, j])
        out[a:b] = value
    return out


def edit_path(a: list[int], b: list[int], most: int) -> list[tuple[int, int, int]] | None:
    """Runs (start in a, start in b, length) of a shortest alignment by insertions and deletions, at most `most`.

    Furthest-reaching diagonals inside the band of `most`; None if the sequences are further apart.
    """
    n, m = len(a), len(b)
    reach, trace = {1: 0}, []
    for d in range(most + 1):
        now = {}
        for diagonal in range(-d, d + 1, 2):
            if diagonal > n or -diagonal > m:
                continue
            down, right = reach.get(diagonal + 1, -1), reach.get(diagonal - 1, -2) + 1
            x = max(down, right)
            if x < 0 or x > n or x - diagonal > m or x - diagonal < 0:
                continue
            while x < n and x - diagonal < m and a[x] == b[x - diagonal]:
                x += 1
            now[diagonal] = x
            if x >= n and x - diagonal >= m:
                trace.append(now)
                return _runs(trace, n - m, n)
        trace.append(now)
        reach = now
    return None


def _runs(trace: list, diagonal: int, x: int) -> list[tuple[int, int, int]]:
    runs = []
    for d in range(len(trace) - 1, 0, -1):
        before = trace[d - 1]
        down, right = before.get(diagonal + 1, -1), before.get(diagonal - 1, -2) + 1
        begin = max(down, right)
        runs.append((begin, begin - diagonal, x - begin))
        if down >= right:
            diagonal, x = diagonal + 1, down
        else:
            diagonal, x = diagonal - 1, right - 1
    runs.append((0, 0, x))
    return [r for r in runs if r[2] > 0]


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Share of five-word shingles that the alignment of two word sequences keeps (0 if surely under the threshold)."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if min(len(a), len(b)) < SHINGLE:
        return 0.0
    na, nb = len(a) - SHINGLE + 1, len(b) - SHINGLE + 1
    need = threshold / (1 + threshold) * (na + nb)
    if min(na, nb) < need - 1e-9:
        return 0.0
    both = np.concatenate([labelled(shingles(a)), labelled(shingles(b))])
    both.sort()
    if (both[1:] == both[:-1]).sum() < need - 1e-9:  # as multisets, in any order, they share too few already
        return 0.0
    head = int(np.argmin(np.append(a[:min(len(a), len(b))] == b[:min(len(a), len(b))], False)))
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[:len(a)].tolist(), codes[len(a):].tolist()
    # Each word inserted or deleted between kept shingles costs a shingle at least, so this band holds every case.
    runs = edit_path(x[head:], y[head:], int(na + nb - 2 * need) + 2 * SHINGLE)
    if runs is None:
        return 0.0
    runs = sorted((i + head, j + head, size) for i, j, size in runs)
    joined = [[0, 0, head]]
    for i, j, size in runs:
        if i == joined[-1][0] + joined[-1][2] and j == joined[-1][1] + joined[-1][2]:
            joined[-1][2] += size
        else:
            joined.append([i, j, size])
    kept = sum(max(0, size - SHINGLE + 1) for _, _, size in joined)
    return kept / (na + nb - kept)


def _sketcher(text: str, threshold: float):
    most = SHORT / threshold + 1e-9  # a partner of a text of SHORT shingles has no more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, texts in words.slices(batch, text):
                _, _, _, hashes, first = words.sliced_words(texts)
                for a, b in zip(first[:-1], first[1:]):
                    values = labelled(shingles(hashes[a:b]))
                    rows.append((sketch(values).view(np.int64).tolist() if len(values) > SHORT else [], int(b - a),
                                 values.view(np.int64).tolist() if SHINGLE <= b - a and len(values) <= most else []))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                                              pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                                             names=["id", "digest", "sketch", "n", "short"])
    return run


def prefix_tokens(shorts: DataFrame, threshold: float) -> DataFrame:
    """(id, n, tokens) from (id, n, short): two texts whose sets `short` have a Jaccard index of `threshold` share a token.

    Texts of m shingles that share the threshold's part of their union share one of the first m - ceil(threshold m) + 1
    of each, in any common order; the order is by rarity, and shingles of one text alone are left out.  A shingle of more
    than HOT texts is one token for each size s <= m of a partner that the shingles from this one on still allow, so
    the pair meets at the size of the smaller, and texts too far down their order for it do not meet there.
    """
    rows = shorts.select("id", "n", F.size("short").alias("m"), F.explode("short").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    held = rows.join(counts, "shingle").groupBy("id", "n", "m").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("held"))
    need = F.ceil(F.lit(threshold) * F.col("m") - 1e-9).cast("int")

    def of_shingle(x, i):
        fits = F.filter(F.sequence(need, F.col("m")), lambda s: F.size("held") - i >= F.lit(threshold / (1 + threshold)) * (F.col("m") + s) - 1e-9)
        return F.when(x["c"] <= HOT, F.array(x["shingle"])).otherwise(F.transform(fits, lambda s: F.xxhash64(x["shingle"], s)))

    first = F.slice("held", F.lit(1), F.greatest(F.size("held") - need + 1, F.lit(0)))
    return held.select("id", "n", F.flatten(F.transform(first, of_shingle)).alias("tokens")).where(F.size("tokens") > 0)


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            pairs = []
            names, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, (name, other) in enumerate(zip(names, ids)):
                value = words.word_arrays(texts[i].as_py().encode())[2]
                if name == other:  # the centre comes before its members
                    centre, own = name, value
                elif centre == name and similar(own, value, threshold) >= threshold:
                    pairs.append((name, other))
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs], pa.int64()) for j in (0, 1)], names=["a", "b"])
    return run


def _bounded(frame: DataFrame, name: str) -> DataFrame:
    """The frame written; broadcast in the next join while it has at most BROADCAST_IDS rows."""
    frame = written(frame, name)
    return F.broadcast(frame) if frame.count() <= BROADCAST_IDS else frame


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = SIMILARITY, salts: int = SALT_ROWS) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar; a hot first text is split over salts, each with its copy."""
    members = pairs.select("a", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.lit(salts)).alias("salt"))
    centres = members.select("a", F.col("a").alias("id"), "salt")
    asked = _bounded(members.unionByName(centres).distinct(), "pairs")
    dealt = (texts.join(asked, "id").select("a", "id", "text", "salt").repartition("a", "salt")
             .sortWithinPartitions("a", "salt", F.col("id") != F.col("a")))
    return dealt.select("a", "id", "text").mapInArrow(_verifier(threshold), "a long, b long")


def _shared_shingles(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in words.slices(batch, text):
                _, _, _, hashes, first = words.sliced_words(texts)
                found = [labelled(shingles(hashes[a:b])).view(np.int64) for a, b in zip(first[:-1], first[1:])]
                ids = np.repeat(np.array(batch.column(0).slice(at, len(texts))), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found))], names=["id", "shingle"])
    return run


def private_shingles(texts: DataFrame) -> DataFrame:
    """(id, u): the shingles of each text that no other of the texts has, where there are any."""
    rows = texts.select("id", "text").mapInArrow(_shared_shingles("text"), "id long, shingle long")
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where(F.col("c") == 1)
    return alone.groupBy("id").agg(F.count(F.lit(1)).alias("u"))


def _alike(n: str, u: str, m: str, v: str, threshold: float):
    """Whether two texts can be similar at all, by their words and private shingles.

    They share no more shingles than either has that are not private; the share of that in their union bounds the
    similarity from above, so nothing similar is left out.
    """
    a, b = F.col(n) - (SHINGLE - 1), F.col(m) - (SHINGLE - 1)
    both = F.least(a - F.col(u), b - F.col(v))
    return (both > 0) & (both >= F.lit(threshold - 1e-9) * (a + b - both))


def parities(values: np.ndarray) -> np.ndarray:
    """A bitmap whose bits tell whether an odd number of the values falls on them.

    Values that two texts share cancel out in the XOR of their bitmaps, so it has at most as many bits as values are in
    one of the texts alone.
    """
    bits = np.bincount(words.mix(values) % np.uint64(64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def _parity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, texts in words.slices(batch, "text"):
            _, _, _, hashes, first = words.sliced_words(texts)
            rows += [parities(labelled(shingles(hashes[a:b]))).tolist() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["id", "bits"])


def _within(n: str, bits: str, m: str, other: str, threshold: float):
    """Whether the bitmaps of two texts of n and m words leave them a similarity of `threshold`.

    At that similarity at most (1 - threshold) / (1 + threshold) of all their shingles are in one of them alone.
    """
    apart = sum(F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other)[i])) for i in range(PARITY_WORDS))
    both = F.col(n) + F.col(m) - 2 * (SHINGLE - 1)
    return apart <= F.lit((1 - threshold) / (1 + threshold)) * both + 1e-6


def _star(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of every bucket's least member with its others, once each."""
    low = members.groupBy("token").agg(F.min(F.struct("id", "n", "u")).alias("low"))
    return (members.join(low, "token").where((F.col("id") != F.col("low.id")) & _alike("n", "u", "low.n", "low.u", threshold))
            .select(F.col("low.id").alias("a"), F.col("id").alias("b")).distinct())


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with their component `c` and the bucket's first `c_low`."""
    known = _bounded(components(links).select(F.col("node").alias("id"), "component"), "components")
    found = members.join(known, "id", "left").select("token", "id", "n", "u", F.coalesce("component", "id").alias("c"))
    several = (found.groupBy("token").agg(F.min("c").alias("c_low"), F.max("c").alias("c_high"), F.count(F.lit(1)).alias("size"))
               .where(F.col("c_low") != F.col("c_high")))
    return written(found.join(several.drop("c_high"), "token"), "mixed")


def similar_links(members: DataFrame, texts: DataFrame, documents: int, threshold: float) -> DataFrame:
    """Links that connect all members of a bucket which any chain of similar members of it connects."""
    links = written(verified(_star(members, threshold), texts, threshold), "links")
    before = float("inf")
    for turn in range(STAR_ROUNDS + 1):
        mixed = _mixed(members, links)
        rest = mixed.where(F.col("c") != F.col("c_low"))
        pairs = rest.agg(F.sum(F.col("size").cast("double"))).first()[0] or 0.0
        if pairs <= 4.0 * documents or pairs > before / 2 or turn == STAR_ROUNDS:
            break
        before = pairs
        # Too many for pairs yet: another star, around some member that the first did not reach.
        centres = rest.groupBy("token").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)), "id", "n", "u", "c")).alias("low"))
        again = (mixed.join(centres, "token").where((F.col("c") != F.col("low.c")) & _alike("n", "u", "low.n", "low.u", threshold))
                 .select(F.col("low.id").alias("a"), F.col("id").alias("b")).distinct())
        links = written(links.unionByName(verified(again, texts, threshold)), "links")
    # All common tokens of a pair that is still apart are here, since their buckets hold several components.
    own = mixed.groupBy("id").agg(F.collect_set("token").alias("sketch"))
    known = written(texts.join(_bounded(mixed.select("id").distinct(), "mixed-ids"), "id").select("id", "text")
                    .mapInArrow(_parity_rows, "id long, bits array<long>"), "parities")
    own = written(own.join(known, "id"), "mixed-sketches")
    own = F.broadcast(own) if own.count() <= BROADCAST_SKETCHES else own
    # A large bucket is cut into blocks of first texts, each with a copy of the members.
    mixed = (mixed.select("token", "id", "n", "u", "c", "c_low", F.ceil(F.col("size") / PAIR_BLOCK).alias("blocks")).join(own, "id"))
    rest = mixed.where(F.col("c") != F.col("c_low")).select(
        "token", F.pmod(F.xxhash64("id"), "blocks").alias("block"),
        *[F.col(x).alias(y) for x, y in (("id", "a"), ("n", "m"), ("u", "v"), ("c", "d"), ("sketch", "other"), ("bits", "other_bits"))])
    mixed = mixed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = (F.col("c") != F.col("d")) & ((F.col("c") == F.col("c_low")) | (F.col("a") < F.col("id")))
    # A pair meets in each of its common tokens; it counts in the least.
    common = F.array_intersect("sketch", "other")
    once = F.array_min(common) == F.col("token")
    fits = both & _alike("n", "u", "m", "v", threshold) & _within("n", "bits", "m", "other_bits", threshold) & once
    left = rest.join(mixed, ["token", "block"]).where(fits).select("a", F.col("id").alias("b"))
    return links.unionByName(verified(left, texts, threshold, PAIR_SALTS))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """key, class_id (least key of the document's class), class_size (distinct keys) for each distinct non-null key.

    Exact copies and chains of links are one class; a document without partner is its own class.  Null texts count as
    empty, and all empty texts are copies; texts under five words only match their copies.  Rows with a null key are
    left out.  Rows of one key are one document: each of its texts matches its exact copies, the one of least digest
    also near copies.  An empty table gives no rows.  Other columns are not read.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.md5(filled).alias("digest"), filled.alias("text"))
    sketches = written(rows.mapInArrow(_sketcher("text", threshold), "id long, digest string, sketch array<long>, n long, short array<long>"), "sketches")
    firsts = sketches.groupBy("digest").agg(F.min(F.struct("id", "n", "sketch", "short")).alias("f"))
    owners = written(sketches.select("id", "digest").join(firsts.select(F.col("f.id").alias("owner"), "digest"), "digest")
                     .select("id", "owner").distinct(), "owners")
    firsts = written(firsts.select("f.*", "digest").groupBy("id").agg(F.min(F.struct("digest", "n", "sketch", "short")).alias("f"))
                     .select("id", "f.*"), "firsts")
    exact = written(prefix_tokens(firsts.where(F.size("short") > 0).select("id", "n", "short"), threshold), "prefixes")
    tokens = (firsts.where(F.col("n") >= SHINGLE).select("id", "n", F.explode("sketch").alias("token"))
              .unionByName(exact.select("id", "n", F.explode("tokens").alias("token"))))
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    members = written(tokens.join(several.drop("c"), "token"), "members")
    ids = _bounded(members.select("id").distinct().join(firsts.select("id", "digest"), "id"), "ids")
    texts = written(rows.join(ids, ["id", "digest"]).select("id", "text").distinct(), "texts")
    # Private shingles rule out most pairs of loosely related texts before any is formed.
    private = _bounded(private_shingles(texts), "private")
    members = members.join(private, "id", "left").select("token", "id", "n", F.coalesce("u", F.lit(0)).alias("u"))
    # With more private ones than this a text is like no other, whatever the other has.
    members = written(members.where(F.col("u") <= (1 - threshold + 1e-9) * (F.col("n") - (SHINGLE - 1))), "members")
    links = similar_links(members, texts, firsts.count(), threshold)
    # Only a key with several texts has several owners; they belong together.
    least = owners.groupBy("id").agg(F.min("owner").alias("a"), F.max("owner").alias("z")).where(F.col("a") != F.col("z"))
    found = components(links.unionByName(owners.join(least, "id").select("a", F.col("owner").alias("b"))))
    every = owners.groupBy("id").agg(F.min("owner").alias("owner")).join(found.withColumnRenamed("node", "owner"), "owner", "left")
    classes = written(every.select("id", F.coalesce("component", "owner").alias("class_id")), "classes")
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return classes.join(sizes, "class_id").select(F.col("id").alias(key), "class_id", "class_size")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` but those whose class has a smaller key, with all their columns; rows without key stay."""
    classes = near_duplicates(docs, key=key, text=text, threshold=threshold)
    others = written(classes.where(F.col(key) != F.col("class_id")).select(F.col(key).alias("_other")), "others")
    gone = F.broadcast(others) if others.count() <= BROADCAST_IDS else others  # eight bytes each
    return docs.join(gone, docs[key].cast("long") == gone["_other"], "left_anti")
