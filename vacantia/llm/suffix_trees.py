"""Substring deduplication by prefix-partitioned suffix trees over words.

Suffixes are split by a prefix of variable length: a prefix whose suffixes would not fit a task's memory is lengthened
word by word, and suffixes of short prefixes share a task, so every group fits.  No tree is built: a task sorts
its suffixes by the 64-bit hash of their first WINDOW words and finds the nodes of that depth as runs of equal hashes, without
an order by words, common prefix lengths or deeper nodes, which do not change what is removed.  A node with two suffixes or
more lies on a repeat; runs of such nodes along a text are its repeats, right-maximal where the run ends.
Prefixes that stay too large at full depth (passages in very many texts) are nodes already: their first places are found
by a minimum per task beforehand and settled where the text is read.

Suffixes travel as hash and place, packed and compressed; texts only meet the places to remove at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import words
from vacantia.llm.shared import written

WINDOW = 20
GROUP_SUFFIXES = 2_000_000
PREFIX_LENGTHS = (1, 2, 4, 8)
SAMPLE_DOCUMENTS = 5000
FREQUENT = 8192
BATCH_WORDS = 1_000_000
BATCH_DOCUMENTS = 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
SCHEMA = "target long, kind string, grp long, payload binary"
NULL_KEY = -(1 << 63)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def path_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the paths of n words that begin at each place (one less per missing word at the end), by doubling."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size, whole, have, length = len(hashes) - n + 1, None, hashes, 1
    done = 0
    while n:
        if n & 1:
            part = have[done:done + size]
            whole = part if whole is None else whole * _power(length) + part
            done += length
        n >>= 1
        if n:
            have = have[:-length] * _power(length) + have[length:]
            length *= 2
    return words.mix(whole)


def planes(values: np.ndarray) -> bytes:
    """Differences of ascending values, byte plane by byte plane, compressed."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    raw = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def from_planes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.empty(0, np.uint64)
    raw = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def pack(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 8], "little")
        out.append(data[at + 8:at + 8 + n])
        at += 8 + n
    return out


def _squeeze(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _open(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
                         if data else b"", kind)


def _grouped(batches: Iterator[pa.RecordBatch], text: str):
    """(keys, digests, first word of each document, word hashes) for groups of documents of bounded size."""
    keys, digests, parts, counts, total = [], [], [], [], 0

    def group():
        return (np.array([NULL_KEY if k is None else k for k in keys], np.int64), np.array(digests, np.int64),
                np.cumsum([0, *counts]), np.concatenate(parts) if parts else np.empty(0, np.uint64))

    for batch in batches:
        own, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, texts in words.slices(batch, text):
            _, _, _, hashes, first = words.sliced_words(texts)
            keys += own[at:at + len(texts)]
            digests += marks[at:at + len(texts)]
            parts.append(hashes)
            counts += np.diff(first).tolist()
            total += len(hashes)
            if total >= BATCH_WORDS or len(keys) >= BATCH_DOCUMENTS:
                yield group()
                keys, digests, parts, counts, total = [], [], [], [], 0
    if keys:
        yield group()


def _suffixes(first: np.ndarray, window: int) -> np.ndarray:
    """Places where a window lies inside its document."""
    lengths = np.maximum(np.diff(first) - window + 1, 0)
    return words.ragged(first[:-1], lengths)


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key among sorted keys, -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Prefixes:
    """Heavy prefixes by length, and the heavy windows with their first places (key, start)."""

    def __init__(self, heavy: dict[int, np.ndarray], windows: np.ndarray, buckets: int):
        self.heavy, self.windows, self.buckets = heavy, windows, buckets
        self.first_key, self.first_start = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)

    def groups(self, hashes: np.ndarray, at: np.ndarray, path: np.ndarray) -> np.ndarray:
        """The group of each suffix: by its shortest prefix that is not heavy, at last by the whole path."""
        group, left = path.copy(), np.arange(len(at))
        for n in PREFIX_LENGTHS:
            if not len(left):
                break
            own = path_hashes(hashes, n)[at[left]]
            light = _member(self.heavy.get(n, np.empty(0, np.uint64)), own) < 0
            group[left[light]] = own[light]
            left = left[~light]
        return (words.mix(group) >> np.uint64(20)) % np.uint64(self.buckets)


def _sample(text: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, first, hashes in _grouped(batches, text):
            at = _suffixes(first, window)
            for n in (*PREFIX_LENGTHS, window):
                found, count = np.unique(path_hashes(hashes, n)[at] if len(at) else np.empty(0, np.uint64), return_counts=True)
                best = np.argsort(-count, kind="stable")[:FREQUENT]
                best = best[count[best] > 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), n)), pa.array(found[best].view(np.int64)),
                                                  pa.array(count[best])], names=["n", "path", "c"])
    return run


def _first_places(shared, text: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Prefixes = shared.value
        key, start = np.full(len(known.windows), np.iinfo(np.int64).max), np.full(len(known.windows), np.iinfo(np.int64).max)
        for keys, _, first, hashes in _grouped(batches, text):
            at = _suffixes(first, window)
            hit = _member(known.windows, path_hashes(hashes, window)[at]) if len(at) else np.empty(0, int)
            at, hit = at[hit >= 0], hit[hit >= 0]
            doc = np.searchsorted(first, at, side="right") - 1
            order = np.lexsort((at - first[doc], keys[doc], hit))
            heads = order[np.flatnonzero(np.diff(hit[order], prepend=-1))]
            h, k, s = hit[heads], keys[doc[heads]], (at - first[doc])[heads]
            less = (k < key[h]) | ((k == key[h]) & (s < start[h]))
            key[h[less]], start[h[less]] = k[less], s[less]
        some = np.flatnonzero(start < np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(key[some]), pa.array(start[some])], names=["w", "k", "s"])
    return run


def find_prefixes(rows: DataFrame, text: str, window: int, group_suffixes: int, sample_documents: int) -> Prefixes:
    """Heavy prefixes and windows as a sample suggests; it only shapes the groups, never the result."""
    spark = rows.sparkSession
    count = rows.count()
    share = min(1.0, sample_documents / max(count, 1))
    sample = rows.sample(share, 3).mapInArrow(_sample(text, window), "n long, path long, c long")
    # Of each length the most frequent, FREQUENT at most, so that table and broadcast are bounded.
    sums = sample.groupBy("n", "path").agg(F.sum("c").alias("c"))
    heavy, words_seen = {}, rows.select(F.sum(F.length(text))).first()[0] or 0
    suffixes = words_seen // 6 + 1
    buckets = max(1, suffixes // group_suffixes + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), suffixes // 100_000))
    for n in PREFIX_LENGTHS:
        least = share * suffixes / buckets / 4
        found = sums.where((F.col("n") == n) & (F.col("c") >= max(2.0, least))).orderBy(F.desc("c"), "path").limit(FREQUENT).collect()
        heavy[n] = np.sort(np.array([r.path for r in found], np.int64).view(np.uint64))
    found = sums.where((F.col("n") == window) & (F.col("c") >= 4)).orderBy(F.desc("c"), "path").limit(FREQUENT).collect()
    known = Prefixes(heavy, np.sort(np.array([r.path for r in found], np.int64).view(np.uint64)), int(buckets))
    if len(known.windows):
        shared = spark.sparkContext.broadcast(known)
        places = rows.mapInArrow(_first_places(shared, text, window), "w long, k long, s long")
        least = places.groupBy("w").agg(F.min(F.struct("k", "s")).alias("at")).collect()
        known.first_start[:] = -1
        for r in least:
            known.first_key[r["w"]], known.first_start[r["w"]] = r["at"]["k"], r["at"]["s"]
    return known


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)],
                                      names=["target", "kind", "grp", "payload"])


def _deal(shared, text: str, window: int):
    """Suffixes to their prefix groups; what heavy windows settle at once; the documents of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Prefixes = shared.value
        # Group numbers of documents lie above those of prefixes, so a target names one or the other.
        grp = (1 << 40) + (TaskContext.get().partitionId() << 20)
        for keys, digests, first, hashes in _grouped(batches, text):
            rows = [(grp, "documents", grp, pack(_squeeze(keys), _squeeze(digests), planes(first)))]
            at = _suffixes(first, window)
            path = path_hashes(hashes, window)[at] if len(at) else np.empty(0, np.uint64)
            doc = np.searchsorted(first, at, side="right") - 1
            hot = _member(known.windows, path)
            mine = np.flatnonzero(hot >= 0)
            again = mine[(keys[doc[mine]] != known.first_key[hot[mine]]) | ((at - first[doc])[mine] != known.first_start[hot[mine]])]
            if len(again):
                rows.append((grp, "repeats", grp, planes(at[again])))
            keep = np.flatnonzero(hot < 0)
            at, path, doc = at[keep], path[keep], doc[keep]
            group = known.groups(hashes, at, path)
            order, runs = words.dealt(group, path)
            for b, x, y in runs:
                own = order[x:y]
                there = np.unique(doc[own])
                rows.append((b, "suffixes", grp, pack(planes(path[own]), _squeeze(at[own].astype(np.uint32)),
                                                      planes(first[there]), _squeeze(keys[there]))))
            yield _rows(rows)
            grp += 1
    return run


def _targets(batches: Iterator[pa.RecordBatch]):
    target, held = None, []
    for batch in batches:
        for t, kind, grp, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and t != target:
                yield target, held
                held = []
            target = t
            held.append((kind, grp, payload))
    if held:
        yield target, held


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each prefix group, the suffixes of its deep nodes but the first of each, back to their documents."""
    for target, found in _targets(batches):
        rows = [(target, kind, grp, payload) for kind, grp, payload in found if kind != "suffixes"]
        found = [x for x in found if x[0] == "suffixes"]
        if found:
            parts = [unpack(p) for _, _, p in found]
            path = np.concatenate([from_planes(p[0]) for p in parts])
            at = np.concatenate([_open(p[1], np.uint32) for p in parts])
            owner = np.repeat(np.arange(len(parts)), [int.from_bytes(p[0][:8], "little") for p in parts])
            order = np.argsort(path, kind="stable")
            ordered = path[order]
            same = ordered[1:] == ordered[:-1]
            deep = np.zeros(len(path), bool)
            deep[1:] |= same
            deep[:-1] |= same
            order = order[deep]
            path, at, owner = path[order], at[order], owner[order]
            key, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            by = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[by], np.arange(len(parts) + 1))
            for i, p in enumerate(parts):
                _place(by[cuts[i]:cuts[i + 1]], at, key, start, p)
            order = np.lexsort((start, key, path))
            path, at, owner, key, start = path[order], at[order], owner[order], key[order], start[order]
            head = np.diff(path, prepend=path[:1] + np.uint64(1)) != 0 if len(path) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(head, np.arange(len(path)), 0)) if len(path) else np.zeros(0, int)
            later = np.flatnonzero((key != key[first]) | (start != start[first]))
            at, owner = at[later], owner[later]
            by = np.lexsort((at, owner))
            cuts = np.searchsorted(owner[by], np.arange(len(parts) + 1)).tolist()
            for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                if x < y:
                    grp = found[i][1]
                    rows.append((grp, "repeats", grp, planes(at[by[x:y]])))
        for i in range(0, len(rows), 256):
            yield _rows(rows[i:i + 256])


def _place(own: np.ndarray, at: np.ndarray, key: np.ndarray, start: np.ndarray, parts: list[bytes]) -> None:
    """Key and start inside the document of the suffixes that one batch of documents sent."""
    first, keys = from_planes(parts[2]).astype(np.int64), _open(parts[3], np.int64)
    doc = np.searchsorted(first, at[own], side="right") - 1
    key[own], start[own] = keys[doc], at[own] - first[doc]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The starts of repeated windows of every document that has any."""
    for _, found in _targets(batches):
        listed = next(unpack(p) for kind, _, p in found if kind == "documents")
        keys, digests, first = _open(listed[0], np.int64), _open(listed[1], np.int64), from_planes(listed[2]).astype(np.int64)
        starts = [from_planes(p) for kind, _, p in found if kind == "repeats"]
        starts = np.sort(np.concatenate(starts)).astype(np.int64) if starts else np.empty(0, np.int64)
        doc = np.searchsorted(first, starts, side="right") - 1
        some, heads = np.unique(doc, return_index=True)
        ends = np.append(heads[1:], len(starts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[some]), pa.array(digests[some]),
             pa.array([planes(starts[a:b] - first[d]) for d, a, b in zip(some, heads, ends)], pa.binary())],
            names=["k", "digest", "starts"])


def repeated_windows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                     group_suffixes: int = GROUP_SUFFIXES, sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """k (key, a null as the least long), digest (xxhash64 of the text), starts: the packed starts of repeated windows.

    A window is repeated if its words also start earlier: at a smaller key, or earlier in the same document.
    """
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("_digest"), F.col(text).alias("_text"))
    known = find_prefixes(rows, "_text", window, group_suffixes, sample_documents)
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most FREQUENT hashes per length
    to = lambda frame: frame.repartition("target").sortWithinPartitions("target")
    found = to(rows.mapInArrow(_deal(shared, "_text", window), SCHEMA)).mapInArrow(_subtrees, SCHEMA)
    found = to(found).mapInArrow(_gather, "k long, digest long, starts binary")
    return written(found.groupBy("k", "digest").agg(F.first("starts").alias("starts")), "repeats")


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of words that repeated windows cover: (first word, behind the last)."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts, prepend=starts[0] - window - 1) > window)
    return [(int(starts[a]), int(starts[b - 1]) + window) for a, b in zip(new, np.append(new[1:], len(starts)))]


def _remove(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, starts = batch.column(1).cast(pa.large_binary()), batch.column(2)
            for i in range(batch.num_rows):
                found = (texts[i].as_py() or b"").split()
                n, gone = len(found), 0
                if (packed := starts[i].as_py()) is not None:
                    drop = covered(from_planes(packed).astype(np.int64), n, window)
                    gone = int(drop.sum())
                    found = [w for w, d in zip(found, drop.tolist()) if not d]
                kept = b" ".join(found)
                out.append((n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[j] for r in out], t) for j, t in enumerate(
                    (pa.int64(), pa.int64(), pa.string(), pa.string())))],
                names=[batch.schema.names[0], "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True,
                   **options) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, kept_text (null unless asked for), one row per input row.

    Removes every word covered by a window of `window` words whose words also start earlier; windows are judged on the
    input.  A null text has no words; a null key comes before all others; rows of one key begin at the same place, so
    equal rows keep what the first of them would.  Other columns are not read.
    """
    found = repeated_windows(docs, key=key, text=text, window=window, **options)
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text"), F.xxhash64(text).alias("digest"),
                       F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k"))
    met = rows.join(found, ["k", "digest"], "left").select(key, "_text", "starts")
    return met.mapInArrow(_remove(window, with_text), f"`{key}` long, n_words long, n_removed long, kept_sha256 string, kept_text string")
