"""Quality rules and line labelling: a linear-chain CRF marks every line of a text as content or boilerplate.

Viterbi decoding gives the likeliest sequence of labels; the share of words in content lines decides retention.
Weights are fitted by gradient ascent of the likelihood (forward-backward) on a bounded sample of labelled documents.
Lines carry no labels of their own: lines of documents of good quality count as content except repeated lines and
notices, lines of bad documents as boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import words

SAMPLE_DOCUMENTS = 4096
STEPS = 150
RATE = 0.5
RIDGE = 1e-3
CONTENT_SHARE = 0.5
MIN_WORDS = 50
REPEAT_PERCENT = 50
SLICE = 1 << 20
NOTICES = (b"licensed under", b"all rights reserved", b"copyright", b"cookie", b"privacy policy", b"terms of use", b"http")
FEATURES = ("bias", "blank", "one_to_three_words", "four_to_ten_words", "over_ten_words", "some_symbols", "many_symbols",
            "upper_case", "exclaims", "digits", "ends_sentence", "repeated_line", "repeats_words", "notice", "short_words",
            "long_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_LEAD = (np.arange(256) & 0xC0) != 0x80


@dataclass
class Crf:
    """emission[feature, label], transition[label before, label], start[label]; label 1 is content."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray


@dataclass
class Lines:
    """Lines of a slice of texts: first line of each text, features, words per line, and counts per text."""

    first: np.ndarray
    features: np.ndarray
    words: np.ndarray
    repeated: np.ndarray
    notice: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeat_cover(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of three words that its document has twice or more."""
    cover = np.zeros(len(hashes), bool)
    if len(hashes) < 3:
        return cover
    inside = np.flatnonzero(doc[2:] == doc[:-2])
    keys = words.window_hashes(hashes, 3)[inside] ^ words.mix(doc[inside].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    often = np.zeros(len(keys), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    at = inside[often]
    for i in range(3):
        cover[at + i] = True
    return cover


def analyse(texts: list[bytes]) -> Lines:
    """Splits the texts at line ends and measures lines and texts."""
    buf, starts, ends, hashes, first_word = words.sliced_words(texts)
    buf = np.append(buf, np.uint8(10))
    breaks = np.flatnonzero(buf == 10)
    line_starts = np.concatenate([[0], breaks[:-1] + 1])
    bounds = np.append(line_starts, len(buf))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(line_starts, offsets)
    doc_of_line = np.repeat(np.arange(len(texts)), np.diff(first))
    doc_of_word = np.repeat(np.arange(len(texts)), np.diff(first_word))
    line_words = np.searchsorted(starts, bounds)
    n = np.diff(line_words)
    size = np.maximum(np.diff(bounds) - 1, 1)
    count = lambda table: _segment_sums(table[buf], bounds)
    symbols, upper, lower, digits = (count(t) for t in (_SYMBOL, _UPPER, _LOWER, _DIGIT))
    exclaims = _segment_sums(buf == 33, bounds)
    lines = words.hash_runs(buf, line_starts)
    keys = np.where(n > 0, lines ^ words.mix(doc_of_line.astype(np.uint64)), 0)
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    again &= n > 0
    cover = _repeat_cover(hashes, doc_of_word)
    covered = _segment_sums(cover, line_words)
    folded = buf.tobytes().lower()
    notice = np.zeros(len(n), bool)
    for phrase in NOTICES:
        at = folded.find(phrase)
        while at >= 0:
            notice[np.searchsorted(line_starts, at, side="right") - 1] = True
            at = folded.find(phrase, at + 1)
    last = np.where(n > 0, buf[ends[np.maximum(line_words[1:] - 1, 0)] - 1] if len(ends) else 0, 0)
    mean = _segment_sums(ends - starts, line_words) / np.maximum(n, 1)
    features = np.stack([
        np.ones(len(n), bool), n == 0, (n > 0) & (n <= 3), (n > 3) & (n <= 10), n > 10,
        (symbols > 0) & (symbols * 50 <= size), symbols * 50 > size, upper > lower, exclaims * 20 > size, digits * 5 > size,
        np.isin(last, list(b".!?:;")), again, covered * 2 > n, notice, (n > 0) & (mean < 3), mean > 12], axis=1)
    lead = _LEAD & ~words.SPACE
    return Lines(first, features, n, again, notice, np.diff(first_word), _segment_sums(lead[buf], offsets),
                 _segment_sums(_SYMBOL[buf], offsets), _segment_sums(again, first), _segment_sums(cover, first_word))


def _padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts from the longest to the shortest, their line counts, and how many texts have a line t."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    return order, lengths, alive


def viterbi(crf: Crf, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The likeliest label of every line; all texts go forward together, one line at a time."""
    emit = features @ crf.emission
    labels = np.zeros(len(features), np.int8)
    back = np.zeros((len(features), 2), np.int8)
    order, lengths, alive = _padded(first)
    begin = first[:-1][order]
    score = np.zeros((len(order), 2))
    for t, k in enumerate(alive):
        at = begin[:k] + t
        if t == 0:
            score[:k] = crf.start + emit[at]
        else:
            paths = score[:k, :, None] + crf.transition
            back[at] = paths.argmax(1)
            score[:k] = paths.max(1) + emit[at]
    state = score.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        labels[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return labels


def _expectations(crf: Crf, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of labels per line, summed marginals of transitions and of starts, by forward-backward."""
    emit = features @ crf.emission
    order, _, alive = _padded(first)
    begin = first[:-1][order]
    forward, backward = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    for t, k in enumerate(alive):
        at = begin[:k] + t
        if t == 0:
            forward[at] = crf.start + emit[at]
        else:
            forward[at] = np.logaddexp.reduce(forward[at - 1][:, :, None] + crf.transition, axis=1) + emit[at]
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = begin[:alive[t]] + t
        step = crf.transition + (emit[at] + backward[at])[:, None, :]
        backward[at - 1] = np.logaddexp.reduce(step, axis=2)
        joint = forward[at - 1][:, :, None] + step
        pairs += np.exp(joint - np.logaddexp.reduce(joint.reshape(len(at), 4), axis=1)[:, None, None]).sum(0)
    both = forward + backward
    marginal = np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])
    return marginal, pairs, marginal[first[:-1][np.diff(first) > 0]].sum(0)


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Crf:
    """Maximum likelihood with a ridge, by gradient ascent with step sizes per weight (AdaGrad)."""
    x, f = features.astype(float), features.shape[1]
    if not len(x):
        return Crf(np.tile([0.0, 1.0], (f, 1)), np.zeros((2, 2)), np.zeros(2))  # without examples all lines are content
    truth = np.eye(2)[labels]
    heads = first[:-1][np.diff(first) > 0]
    follow = np.setdiff1d(np.arange(len(x)), heads)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[follow - 1], labels[follow]), 1)
    w, held = np.zeros(f * 2 + 6), np.zeros(f * 2 + 6)
    for _ in range(steps):
        crf = Crf(w[:2 * f].reshape(f, 2), w[2 * f:2 * f + 4].reshape(2, 2), w[2 * f + 4:])
        marginal, pairs, starts = _expectations(crf, x, first)
        slope = np.concatenate([(x.T @ (truth - marginal)).ravel(), (seen - pairs).ravel(), truth[heads].sum(0) - starts])
        slope = slope / len(x) - RIDGE * w
        held += slope ** 2
        w = w + RATE * slope / np.sqrt(held + 1e-12)
    return Crf(w[:2 * f].reshape(f, 2), w[2 * f:2 * f + 4].reshape(2, 2), w[2 * f + 4:])


def _measure(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            quality = batch.column(1).to_pylist()
            for at, texts in words.slices(batch, text, SLICE):
                found = analyse(texts)
                for i in range(len(texts)):
                    part = slice(found.first[i], found.first[i + 1])
                    good = (quality[at + i] > 0) & ~found.repeated[part] & ~found.notice[part]
                    rows.append((np.packbits(found.features[part]).tobytes(), np.packbits(good).tobytes(), len(good)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(
                (pa.binary(), pa.binary(), pa.int64())))], names=["place", "features", "good", "n"])
    return run


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample_documents: int = SAMPLE_DOCUMENTS) -> Crf:
    """A CRF fitted to at most `sample_documents` labelled documents, those of the lowest hashed keys.

    Labels with a null key or value do not count; of several labels of a document the lowest counts.
    """
    place = F.xxhash64(F.col(key), F.lit(13))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_good"))
    sample = known.select(F.col(key).alias("_key"), "_good", place.alias("_place")).orderBy("_place").limit(sample_documents)
    rows = (docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")  # bounded by the sample
            .select("_place", "_good", "_text"))
    table = rows.mapInArrow(_measure("_text"), "place long, features binary, good binary, n long").toPandas()
    table = table.sort_values(["place", "features"])
    f = len(FEATURES)
    x = [np.unpackbits(np.frombuffer(b, np.uint8), count=n * f).reshape(n, f) for b, n in zip(table["features"], table["n"])]
    y = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(table["good"], table["n"])]
    return fit(np.concatenate(x) if x else np.zeros((0, f)), np.cumsum([0, *table["n"]]),
               np.concatenate(y).astype(int) if y else np.zeros(0, int))


def _labeller(shared, text: str, share: float, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            parts = []
            for _, texts in words.slices(batch, text, SLICE):
                found = analyse(texts)
                label = viterbi(crf, found.features, found.first)
                content = _segment_sums(found.words * (label == 1), found.first)
                failed = (found.n_words < MIN_WORDS) | (100 * found.n_repeat_words > REPEAT_PERCENT * found.n_words)
                parts.append([found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words,
                              failed, ~failed & (content >= share * found.n_words), content, np.diff(found.first)])
            columns = [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, bool if 5 <= j <= 6 else np.int64)
                       for j in range(len(fields))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=[batch.schema.names[0], *fields])
    return run


def label_lines(docs: DataFrame, crf: Crf, *, key: str = "doc_id", text: str = "text",
                content_share: float = CONTENT_SHARE) -> DataFrame:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_content_words, n_lines.

    `base_failed`: under 50 words, or over half of them in three-word windows found twice; `kept`: not failed, and the
    CRF finds at least `content_share` of the words in content lines.  A null text counts as empty: one blank line,
    failed.  One row per input row, whatever its key; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # some forty weights
    kind = docs.schema[key].dataType.simpleString()
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
              "n_content_words", "n_lines"]
    types = ", ".join(f"{f} boolean" if f in ("base_failed", "kept") else f"{f} long" for f in fields)
    return docs.select(key, text).mapInArrow(_labeller(shared, text, content_share, fields), f"`{key}` {kind}, {types}")


def line_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Trains on the labelled documents and labels the lines of all documents."""
    return label_lines(docs, train(docs, labels, **options))
