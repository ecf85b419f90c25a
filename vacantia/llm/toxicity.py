"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it.

The later models are trained on out-of-fold probabilities of the earlier ones, so they learn from predictions of the
quality that they will get.  Features are rates of hashed character n-grams of folded words with their edges, which also
meet compounds and inflected forms that are rare as whole words.  Training takes a bounded sample of labelled documents; scoring
covers every whole text.

Categories are columns of the label table.  Where it has only the target, kinds of toxic documents are learned: clusters
of the sampled toxic documents by the n-grams that tell them from the others; each kind is a link before the target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.llm import shared, words

SAMPLE_DOCUMENTS = 8192
FEATURES = 512
LENGTHS = (3, 4, 5, 6)
BITS = 18  # n-grams are hashed to 2^18 places
LEAST_WEIGHT = 3.0  # documents that hold a feature, copies counting together as one
KINDS = 3
FOLDS = 5
RIDGE = 0.1
PER = 100  # a feature is log(1 + occurrences in so many words)
SEGMENT = 1 << 20
TARGET = "toxic"

_FOLD = np.arange(256, dtype=np.uint8)
for _i in range(128):
    _c = chr(_i)
    _FOLD[_i] = ord(_c.lower()) if _c.isalnum() else 32


def folded(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, other ASCII characters than letters and digits as spaces (UTF-8 bytes)."""
    out = _FOLD[buf]
    capital = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    out[capital] += 0x20
    return out


def _places(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the n-grams of all texts; with `wanted` only those at a wanted place, in segments of bounded size.

    An n-gram lies in one word; the spaces around the word count as its edges.
    """
    buf = folded(np.frombuffer(b" " + b"\n".join(texts) + b" ", np.uint8)) if texts else np.empty(0, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1  # an n-gram that begins on a separator belongs to the next text
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.uint32))]
    longest = max(LENGTHS)
    for start in range(0, len(buf), SEGMENT):
        part = buf[start:start + SEGMENT + longest - 1].astype(np.uint32)
        spaces = np.cumsum(part == 32, dtype=np.uint32)
        h = part * np.uint32(0x9E3779B1)
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            h = (h[:-1] * np.uint32(0x01000193)) ^ (part[n - 1:] * np.uint32(0x85EBCA6B))
            if n not in LENGTHS:
                continue
            place = h ^ (h >> np.uint32(15))
            place *= np.uint32(0x2C1B3C6D)
            place ^= place >> np.uint32(13)
            place >>= np.uint32(32 - BITS)
            place = place[:SEGMENT]
            at = np.arange(len(place)) if wanted is None else np.flatnonzero(wanted[place])
            at = at[spaces[at + n - 2] == spaces[at]]
            found.append((np.searchsorted(ends, start + at + 1, side="right"), place[at]))
    doc, place = (np.concatenate(x) for x in zip(*found))
    return np.minimum(doc, len(texts) - 1), place


@dataclass
class Chain:
    """Places of the features; per link: weights of features, then of earlier links' probabilities, then the bias."""

    features: np.ndarray
    names: list[str]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.names)))
        for j, w in enumerate(self.weights):
            out[:, j] = _sigmoid(np.hstack([x, out[:, :j], np.ones((len(x), 1))]) @ w)
        return out

    def rates(self, texts: list[bytes]) -> np.ndarray:
        """The features of each text."""
        x = np.zeros((len(texts), len(self.features)))
        if len(self.features):
            number = np.full(1 << BITS, -1)
            number[self.features] = np.arange(len(self.features))
            doc, place = _places(texts, number >= 0)
            np.add.at(x, (doc, number[place]), 1)
            some = np.flatnonzero(x.any(axis=1))
            x[some] = rate(x[some], word_counts(texts)[some, None])
        return x


def word_counts(texts: list[bytes]) -> np.ndarray:
    return np.array([len(t.split()) for t in texts], np.int64)


def rate(occurrences: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.log1p(PER * occurrences / np.maximum(n_words, 1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the bias (last weight) is hardly held back."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + hold * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold + 1e-9)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learned_kinds(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, kinds: int) -> np.ndarray:
    """(document, kind): spherical k-means of the toxic documents, started from documents far from one another."""
    out = np.zeros((len(x), kinds))
    at = np.flatnonzero((toxic > 0) & x.any(axis=1))
    if not len(at):
        return out
    unit = x[at] / np.sqrt((x[at] ** 2).sum(axis=1, keepdims=True))
    centres = [unit[np.lexsort((np.arange(len(at)), -unit @ unit.sum(axis=0)))[0]]]
    for _ in range(kinds - 1):
        centres.append(unit[np.argmin((unit @ np.array(centres).T).max(axis=1))])
    centre = np.array(centres)
    for _ in range(25):
        own = (unit @ centre.T).argmax(axis=1)
        now = np.array([(unit[own == k] * weight[at][own == k, None]).sum(axis=0) if (own == k).any() else centre[k] for k in range(kinds)])
        now /= np.sqrt((now ** 2).sum(axis=1, keepdims=True))
        if np.allclose(now, centre):
            break
        centre = now
    out[at, (unit @ centre.T).argmax(axis=1)] = 1
    return out


def fit_chain(features: np.ndarray, x: np.ndarray, links: np.ndarray, names: list[str], folds: np.ndarray, weight: np.ndarray) -> Chain:
    """Fits the links (document, link) in order; each sees the out-of-fold probabilities of those before it."""
    weights, earlier = [], np.zeros((len(x), 0))
    for y in links.T:
        known = np.hstack([x, earlier])
        weights.append(fit_logistic(known, y, weight))
        out = np.zeros(len(x))
        for f in np.unique(folds):
            inside = folds == f
            w = fit_logistic(known[~inside], y[~inside], weight[~inside])
            out[inside] = _sigmoid(np.hstack([known[inside], np.ones((inside.sum(), 1))]) @ w)
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(features, names, weights)


def _sample_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark, distinct places and their rates of each document; documents with equal marks are taken for copies of one another.

    The mark is the least hash of the five-word windows; a text without words has its own.
    """
    for batch in batches:
        marks, found, rates = [], [], []
        for first, texts in words.slices(batch, "_text"):
            _, _, _, hashes, begin = words.sliced_words(texts)
            doc, place = _places(texts)
            key, often = np.unique((doc.astype(np.uint64) << np.uint64(32)) | place, return_counts=True)
            often = rate(often, np.diff(begin)[(key >> np.uint64(32)).astype(np.int64)]).astype(np.float32)
            cuts = np.searchsorted(key >> np.uint64(32), np.arange(len(texts) + 1))
            for i, (a, b, u, v) in enumerate(zip(cuts[:-1], cuts[1:], begin[:-1], begin[1:])):
                found.append((key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                rates.append(often[a:b].tobytes())
                own = words.window_hashes(hashes[u:v], min(5, max(v - u, 1)))
                marks.append(int(own.min().view(np.int64)) if len(own) else batch.column(0)[first + i].as_py())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.int64()), pa.array(found, pa.binary()), pa.array(rates, pa.binary())],
                                         names=[*batch.schema.names[:-1], "mark", "places", "rates"])


def _place_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per place: documents and toxic documents that have it, by weight; one table of fixed size for each task."""
    n, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for batch in batches:
        for toxic, weight, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            at = np.frombuffer(places.as_buffer(), np.uint32)
            n[at] += weight
            bad[at] += weight * (toxic > 0)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(bad[at])], names=["bucket", "n", "bad"])


def _chosen(batches: Iterator[pa.RecordBatch], features: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Only the chosen features: their numbers and rates."""
    for batch in batches:
        at, to = batch.schema.get_field_index("places"), batch.schema.get_field_index("rates")
        number, kept = [], []
        for places, rates in zip(batch.column(at), batch.column(to)):
            _, mine, there = np.intersect1d(features, np.frombuffer(places.as_buffer(), np.uint32), assume_unique=True, return_indices=True)
            number.append(mine.astype(np.int32).tobytes())
            kept.append(np.frombuffer(rates.as_buffer(), np.float32)[there].tobytes())
        yield batch.set_column(at, "places", pa.array(number, pa.binary())).set_column(to, "rates", pa.array(kept, pa.binary()))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = TARGET,
          categories: Sequence[str] = (), kinds: int = KINDS, sample_documents: int = SAMPLE_DOCUMENTS, n_features: int = FEATURES) -> Chain:
    """A chain fitted to at most `sample_documents` labelled documents, those of the lowest hashed keys.

    `categories` are 0/1 columns of the labels, in chain order before the target; without any, `kinds` are learned.  Rows
    with a null key or target do not count, a null category counts as 0; of several labels of a document the highest counts.
    Copies share the weight of one document.  Without labelled documents every probability is 1/2.
    """
    spark = docs.sparkSession
    place = F.xxhash64(F.col(key), F.lit(11))
    flags = [F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"_c{i}") for i, c in enumerate(categories)]
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("toxic"), *flags)
    own = [f"_c{i}" for i in range(len(categories))]
    sample = known.select(F.col(key).alias("_key"), "toxic", *own, place.alias("place")).orderBy("place").limit(sample_documents)
    rows = (docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")  # bounded by the sample
            .select("place", "toxic", F.pmod("place", F.lit(FOLDS)).cast("int").alias("fold"), *own, "_text"))
    kinds_of = "place long, toxic int, fold int, " + "".join(f"{c} int, " for c in own)
    held = shared.written(rows.mapInArrow(_sample_places, kinds_of + "mark long, places binary, rates binary"), "toxicity-sample")
    held = held.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("mark")))  # the sample only
    total = held.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * (F.col("toxic") > 0).cast("int")).alias("bad")).first()
    share = min(max((total["bad"] or 0.0) / (total["n"] or 1.0), 1e-9), 1 - 1e-9)
    counts = held.select("toxic", "weight", "places").mapInArrow(_place_counts, "bucket long, n double, bad double").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    score = F.round(F.pow(F.col("bad") - F.col("n") * share, 2) / (F.col("n") * share * (1 - share)), 6)
    best = counts.where(F.col("n") >= LEAST_WEIGHT).orderBy(score.desc(), "bucket").limit(n_features).collect()
    features = np.sort(np.array([r["bucket"] for r in best], np.int64))
    features_shared = spark.sparkContext.broadcast(features)
    table = held.drop("mark").mapInArrow(lambda b: _chosen(b, features_shared.value), kinds_of + "places binary, rates binary, weight double").toPandas()
    table = table.sort_values(["place", "places", "rates"]).reset_index(drop=True)
    x = np.zeros((len(table), len(features)))
    for i, (places, rates) in enumerate(zip(table["places"], table["rates"])):
        x[i, np.frombuffer(places, np.int32)] = np.frombuffer(rates, np.float32)
    toxic, weight = table["toxic"].to_numpy(float) > 0, table["weight"].to_numpy(float)
    before = table[own].to_numpy(float) > 0 if own else learned_kinds(x, toxic, weight, kinds)
    links = np.hstack([before, toxic[:, None]]).astype(float)
    names = [*(categories or (f"kind_{k + 1}" for k in range(kinds))), TARGET]
    return fit_chain(features, x, links, names, table["fold"].to_numpy(int), weight)


def _scorer(chain_shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = chain_shared.value
        for batch in batches:
            out = [np.zeros((0, len(chain.names)))]
            for _, texts in words.slices(batch, text):
                out.append(chain.probabilities(chain.rates(texts)))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j]) for j in range(p.shape[1]))],
                                             names=[batch.schema.names[0], *(f"p_{n}" for n in chain.names)])
    return run


def score(docs: DataFrame, chain: Chain, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """key, p_<category> of every link and `toxic` (the last probability exceeds the threshold), one row per input row.

    Null and empty texts get the probabilities of a text without known n-grams; keys may be null or repeated; other
    columns are not read.
    """
    chain_shared = docs.sparkSession.sparkContext.broadcast(chain)  # a few thousand weights
    kind = docs.schema[key].dataType.simpleString()
    fields = ", ".join([f"`{key}` {kind}", *(f"p_{n} double" for n in chain.names)])
    return (docs.select(key, text).mapInArrow(_scorer(chain_shared, text), fields)
            .withColumn(TARGET, F.col(f"p_{chain.names[-1]}") > threshold))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Trains on the labelled documents and scores all documents."""
    return score(docs, train(docs, labels, **options))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of `docs` that the chain does not call toxic, with all their columns.

    Null and empty texts, null keys and repeated rows stay as long as a text without known n-grams is not toxic; an empty
    table stays empty; without labels nothing is dropped.
    """
    chain_shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text=text, **options))

    def keeps():
        chain = chain_shared.value
        return lambda texts: chain.probabilities(chain.rates(texts))[:, -1] <= threshold

    return shared.rows_where(docs, text, keeps)
