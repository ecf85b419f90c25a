"""Language-model scores of a Katz backoff bigram model, counted on the corpus and evaluated on all of it.

p(w|h) = D(r(h,w)) / (c(h)+1) if the pair was seen, else alpha(h) p(w); p(w) = D(c(w)) / (N+1), the rest for unknown words.
D is Katz's Good-Turing discount for counts up to LARGE; one reserved event per history keeps mass for unseen words, and
alpha(h) = (1 - sum of seen p(w|h)) / (1 - sum of p of those words) makes every distribution sum to one.  A text is preceded
and followed by the end token, so the histories of a text are its own tokens once more.

Word occurrences travel once, packed and compressed, to partitions of the word, which know its count and those of its
pairs.  They return sums per document, and per history what alpha needs.  Only held-out documents can meet unseen pairs:
their histories are looked up in partitions of the history.  Discounts are not needed until all counts are known, since
sums are kept per count class.  A bounded table of frequent words and pairs, counted exactly on the whole corpus
beforehand, takes the heavy keys out of the partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import words
from vacantia.llm.shared import written

LARGE = 5
HOT = 2048
SAMPLE_DOCUMENTS = 5000
GROUP_TOKENS = 800_000
GROUP_DOCUMENTS = 20_000
BUCKET_ENTRIES = 1_500_000
END = np.uint64(0x5851F42D4C957F2D)
UNIT = float(1 << 30)  # sums of logarithms travel as whole numbers of this part
FOLDS, HELD_FOLD = 7, 2
# Per document: known tokens, sum of log(c+1), seen pairs by count class, sum of log(r) of larger ones, unseen pairs by
# class of the word's count (0 first, larger ones last), sum of log(c) of the larger ones, sum over histories.
KNOWN, LOGC, SEEN, SEEN_LOG = 0, 1, 2, 2 + LARGE
UNSEEN = SEEN_LOG + 1
UNSEEN_LOG = UNSEEN + LARGE + 2
HISTORY = UNSEEN_LOG + 1
COLUMNS = HISTORY + 1
SUMS = 2 * (LARGE + 1)  # per history: pairs by class, larger counts; their words by class, larger counts
SCHEMA = "target long, kind string, grp long, payload binary, numbers array<long>"


def pack(*columns: np.ndarray) -> bytes:
    parts = []
    for c in columns:
        raw = np.ascontiguousarray(c).tobytes()
        data = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        parts.append(np.array([len(raw), len(data), ord(c.dtype.char)], np.int64).tobytes() + data)
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        raw, size, kind = np.frombuffer(data, np.int64, 3, at).tolist()
        body = pa.decompress(data[at + 24:at + 24 + size], decompressed_size=raw, codec="zstd", asbytes=True) if raw else b""
        out.append(np.frombuffer(body, np.dtype(chr(kind))))
        at += 24 + size
    return out


def pair_key(word: np.ndarray, history: np.ndarray) -> np.ndarray:
    return words.mix(word * np.uint64(0xD6E8FEB86659FD93) + history)


def is_held(key: int | None) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % FOLDS == HELD_FOLD


def _grouped(batches: Iterator[pa.RecordBatch], text: str):
    """(keys, held, tokens, histories, document of each token) for groups of documents of bounded size."""
    keys: list = []
    parts: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    count = 0

    def group():
        token = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        return (keys, np.array([is_held(k) for k in keys], bool), token, np.concatenate([[END], token[:-1]]).astype(np.uint64),
                np.concatenate(owner).astype(np.int64))

    for batch in batches:
        own = batch.column(0).to_pylist()
        for at, texts in words.slices(batch, text):
            _, _, _, hashes, first = words.sliced_words([t.lower() for t in texts])
            parts.append(np.insert(hashes, first[1:], END))
            owner.append(len(keys) + np.repeat(np.arange(len(texts)), np.diff(first) + 1))
            keys = keys + own[at:at + len(texts)]
            count += len(parts[-1])
            if count >= GROUP_TOKENS or len(keys) >= GROUP_DOCUMENTS:
                yield group()
                keys, parts, owner, count = [], [], [], 0
    if keys:
        yield group()


class Frequent:
    """Sorted keys of frequent words and pairs with their exact training counts."""

    def __init__(self, word_keys: np.ndarray, pairs: np.ndarray):
        self.words = np.unique(np.concatenate([word_keys, pairs[:, 0], pairs[:, 1], [END]]).astype(np.uint64))
        key = pair_key(pairs[:, 0], pairs[:, 1])
        order = np.argsort(key)
        self.pairs, self.pair_word, self.pair_history = key[order], pairs[order, 0], pairs[order, 1]
        self.word_counts, self.pair_counts = np.zeros(len(self.words), np.int64), np.zeros(len(self.pairs), np.int64)
        self.tokens = 0

    @staticmethod
    def place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where there is none."""
        if not len(sorted_keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, at, -1)


def _sample_counts(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, token, history, _ in _grouped(batches, text):
            one, n = np.unique(token, return_counts=True)
            best = np.argsort(-n, kind="stable")[:4 * HOT]
            key, first, m = np.unique(pair_key(token, history), return_index=True, return_counts=True)
            top = np.argsort(-m, kind="stable")[:4 * HOT]
            w = np.concatenate([one[best], token[first[top]]]).view(np.int64)
            h = np.concatenate([np.zeros(len(best), np.int64), history[first[top]].view(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(h), pa.array(np.arange(len(w)) >= len(best)),
                                              pa.array(np.concatenate([n[best], m[top]]))], names=["w", "h", "pair", "n"])
    return run


def _exact_counts(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Frequent = shared.value
        total = np.zeros(1 + len(table.words) + len(table.pairs), np.int64)
        for _, held, token, history, doc in _grouped(batches, text):
            train = ~held[doc]
            token, history = token[train], history[train]
            total[0] += len(token)
            at = Frequent.place(table.words, token)
            total[1:1 + len(table.words)] += np.bincount(at[at >= 0], minlength=len(table.words))
            at = Frequent.place(table.pairs, pair_key(token, history))
            total[1 + len(table.words):] += np.bincount(at[at >= 0], minlength=len(table.pairs))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])
    return run


def frequent_table(docs: DataFrame, text: str, sample_documents: int) -> Frequent:
    """Frequent words and pairs of a sample (at most HOT each), with counts over all training documents."""
    spark = docs.sparkSession
    sample = docs.sample(min(1.0, sample_documents / max(docs.count(), 1)), 5)
    counts = sample.mapInArrow(_sample_counts(text), "w long, h long, pair boolean, n long").groupBy("w", "h", "pair").agg(F.sum("n").alias("n"))
    rows = [counts.where(F.col("pair") == p).where("n > 1").orderBy(F.desc("n"), "w", "h").limit(HOT).collect() for p in (False, True)]
    as_key = lambda values: np.array(values, np.int64).view(np.uint64)
    table = Frequent(as_key([r.w for r in rows[0]]), as_key([(r.w, r.h) for r in rows[1]]).reshape(-1, 2))
    shared = spark.sparkContext.broadcast(table)  # a few thousand keys
    exact = docs.mapInArrow(_exact_counts(shared, text), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(1 + len(table.words) + len(table.pairs), np.int64)
    for r in exact:
        total[r.place] = r.n
    table.tokens = int(total[0])
    table.word_counts, table.pair_counts = total[1:1 + len(table.words)], total[1 + len(table.words):]
    return table


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


def _log(n: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(n, 1))


def document_sums(size: int, doc: np.ndarray, held: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The COLUMNS of `size` documents from entries: document, held out, count of the word, count of the pair."""
    out = np.zeros((size, COLUMNS), np.int64)
    add = lambda column, at, value=None: np.add.at(out[:, column], at, 1 if value is None else value)
    add(KNOWN, doc[count > 0])
    add(LOGC, doc, _units(_log(count + 1)))
    for r in range(1, LARGE + 1):
        add(SEEN + r - 1, doc[pairs == r])
    big = pairs > LARGE
    add(SEEN_LOG, doc[big], _units(_log(pairs[big])))
    new = (pairs == 0) & held
    for c in range(LARGE + 1):
        add(UNSEEN + c, doc[new & (count == c)])
    big = new & (count > LARGE)
    add(UNSEEN + LARGE + 1, doc[big])
    add(UNSEEN_LOG, doc[big], _units(_log(count[big])))
    return out


def history_sums(group: np.ndarray, size: int, pairs: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The SUMS of `size` histories from distinct seen pairs: history number, count of the pair, count of the word."""
    out = np.zeros((size, SUMS), np.int64)
    for base, n in ((0, pairs), (LARGE + 1, count)):
        small = n <= LARGE
        np.add.at(out, (group[small], base + n[small] - 1), 1)
        np.add.at(out[:, base + LARGE], group[~small], n[~small])
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)],
                                      names=["target", "kind", "grp", "payload", "numbers"])


def _by_document(rows: list, sums: np.ndarray, grp: int) -> None:
    some = np.flatnonzero(sums.any(axis=1))
    if len(some):
        rows.append((grp, "documents", grp, pack(some.astype(np.uint32), *sums[some].T), None))


def _deal(shared, text: str, buckets: int):
    """Entries of every group of documents, packed for the partition of their word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Frequent = shared.value
        grp = TaskContext.get().partitionId() << 32
        for keys, held, token, history, doc in _grouped(batches, text):
            rows: list[tuple] = []
            n = np.bincount(doc, minlength=len(keys))
            known = np.array([k is not None for k in keys], bool)
            ids = np.array([k or 0 for k in keys], np.int64)
            rows.append((grp, "keys", grp, pack(ids, known.view(np.uint8), held.view(np.uint8), n), None))
            pair = pair_key(token, history)
            hot = Frequent.place(table.pairs, pair)
            mine = hot >= 0
            if mine.any():  # settled here: the table knows both words and the pair
                at, out = hot[mine], held[doc[mine]]
                count = table.word_counts[Frequent.place(table.words, table.pair_word)][at]
                before = table.word_counts[Frequent.place(table.words, table.pair_history)][at]
                seen = table.pair_counts[at]
                sums = document_sums(len(keys), doc[mine], out, count, seen)
                np.add.at(sums[:, HISTORY], doc[mine][out & (seen > 0)], -_units(_log(before[out & (seen > 0)] + 1)))
                _by_document(rows, sums, grp)
                lost = np.flatnonzero(mine)[out & (seen == 0)]
                if len(lost):
                    rows += _histories(history[lost], doc[lost], np.zeros(len(lost), np.uint8), np.full(len(lost), grp), buckets)
            keep = np.flatnonzero(~mine)
            token, history, doc, pair = token[keep], history[keep], doc[keep], pair[keep]
            spread = np.where(Frequent.place(table.words, token) >= 0, pair, words.mix(token))
            bucket = (spread >> np.uint64(16)) % np.uint64(buckets)
            order, runs = words.dealt(bucket, token)
            token, history, doc = token[order], history[order], doc[order]
            out = held[doc]
            for b, x, y in runs:
                rows.append((b, "entries", grp, pack(token[x:y], history[x:y], doc[x:y].astype(np.uint32), out[x:y].view(np.uint8)), None))
            yield _rows(rows)
            grp += 1
    return run


def _histories(history: np.ndarray, doc: np.ndarray, seen: np.ndarray, grp: np.ndarray, buckets: int) -> list[tuple]:
    """Entries of held-out documents, of any groups, for the partitions of their histories: a row for each."""
    bucket = words.mix(history) % np.uint64(buckets)
    order = np.lexsort((doc, grp, bucket))
    bucket, history, doc, seen, grp = bucket[order], history[order], doc[order], seen[order], grp[order]
    return [(b, "asked", 0, pack(history[x:y], doc[x:y].astype(np.uint32), seen[x:y], grp[x:y]), None) for b, x, y in words.occupied(bucket)]


def _partitions(batches: Iterator[pa.RecordBatch]):
    """Rows of one target after another; the input is sorted by it."""
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


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows that each row is in."""
    new = np.zeros(len(sorted_columns[0]), bool)
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _count_words(shared, buckets: int):
    """Counts of the words and pairs of each partition; sums for their documents and histories."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Frequent = shared.value
        for t, found in _partitions(batches):
            rows: list[tuple] = [(t, kind, grp, payload, None) for kind, grp, payload in found if kind != "entries"]
            found = [x for x in found if x[0] == "entries"]
            if not found:
                yield _rows(rows)
                continue
            groups = [g for _, g, _ in found]
            parts = [unpack(p) for _, _, p in found]
            token, history, doc, held = (np.concatenate([p[j] for p in parts]) for j in range(4))
            owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            sizes = [int(p[2].max()) + 1 for p in parts]
            del parts
            order = np.lexsort((history, token))
            token, history, doc, held, owner = token[order], history[order], doc[order], held[order].astype(bool), owner[order]
            train = ~held
            word = _runs(token)
            count = np.bincount(word, weights=train).astype(np.int64)
            names = token[np.flatnonzero(np.diff(word, prepend=-1))]
            hot = Frequent.place(table.words, names)
            count[hot >= 0] = table.word_counts[hot[hot >= 0]]
            pair = _runs(token, history)
            seen = np.bincount(pair, weights=train).astype(np.int64)
            heads = np.flatnonzero(np.diff(pair, prepend=-1))
            own = count[(hot < 0) & (count > 0)]
            tally = [np.bincount(np.minimum(x, LARGE + 2), minlength=LARGE + 3)[1:LARGE + 2] for x in (seen[seen > 0], own)]
            rows.append((0, "totals", 0, None, [*tally[0].tolist(), *tally[1].tolist(), len(own)]))
            c, r = count[word], seen[pair]
            by = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[by], np.arange(len(groups) + 1))
            for i, grp in enumerate(groups):
                at = by[cuts[i]:cuts[i + 1]]
                _by_document(rows, document_sums(sizes[i], doc[at], held[at], c[at], r[at]), grp)
            out = np.flatnonzero(held)
            rows += _histories(history[out], doc[out], (r[out] > 0).astype(np.uint8), np.array(groups, np.int64)[owner[out]], buckets)
            some = heads[seen > 0]
            before, number = np.unique(history[some], return_inverse=True)
            sums = history_sums(number, len(before), seen[seen > 0], c[some])
            often = Frequent.place(table.words, before)
            for i in np.flatnonzero(often >= 0):
                rows.append((int(often[i]), "frequent", 0, None, sums[i].tolist()))
            before, sums = before[often < 0], sums[often < 0]
            bucket = words.mix(before) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            rows += [(b, "histories", 0, pack(before[order[x:y]], *sums[order[x:y]].T), None) for b, x, y in words.occupied(bucket[order])]
            for i in range(0, len(rows), 256):
                yield _rows(rows[i:i + 256])
    return run


class Model:
    """Discounts and totals; turns class sums into probabilities."""

    def __init__(self, pair_tally: list[int], word_tally: list[int], tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        self.pair = discounted(pair_tally)
        self.word = discounted(word_tally)
        used = 0.0
        for c in range(1, LARGE + 1):
            used += word_tally[c - 1] * self.word[c - 1]
        self.small = used
        low = sum(c * word_tally[c - 1] for c in range(1, LARGE + 1))
        self.unknown = 1 - (used + tokens - low) / (tokens + 1)

    def alpha(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(backoff weight, count) of histories from their SUMS."""
        count = sums[:, :LARGE] @ np.arange(1, LARGE + 1) + sums[:, LARGE]
        kept = (sums[:, :LARGE] @ self.pair + sums[:, LARGE]) / (count + 1)
        lower = (sums[:, LARGE + 1:-1] @ self.word + sums[:, -1]) / (self.tokens + 1)
        return (1 - kept) / np.maximum(1 - lower, self.unknown), count

    def scores(self, sums: np.ndarray, n: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(base score, score) of documents."""
        base = sums[:, LOGC] / UNIT - n * np.log10(self.tokens + self.distinct + 1)
        seen = sums[:, SEEN:SEEN + LARGE] @ np.log10(self.pair) + sums[:, SEEN_LOG] / UNIT
        low = np.concatenate([[np.log10(self.unknown)], np.log10(self.word / (self.tokens + 1)),
                              [-np.log10(self.tokens + 1)]])
        unseen = sums[:, UNSEEN:UNSEEN_LOG] @ low + sums[:, UNSEEN_LOG] / UNIT
        return base, np.where(held, seen + unseen + sums[:, HISTORY] / UNIT, seen - sums[:, LOGC] / UNIT)


def discounted(tally: list[int]) -> np.ndarray:
    """D(1)..D(LARGE) from counts of counts 1..LARGE+1; r - 1/2 where Good-Turing gives nothing between 0 and r."""
    n = np.array(tally, float)
    out = np.arange(1, LARGE + 1) - 0.5
    if n[0] > 0:
        common = (LARGE + 1) * n[LARGE] / n[0]
        for r in range(1, LARGE + 1):
            if n[r - 1] > 0 and n[r] > 0 and common < 1:
                ratio = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
                if 0 < ratio < 1:
                    out[r - 1] = ratio * r
    return out


def _ask_histories(shared, model_shared):
    """The histories' part of held-out scores: log of the backoff weight for unseen pairs, of 1/(c+1) for seen ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (model, hot_sums) = shared.value, model_shared.value
        hot_alpha, hot_count = model.alpha(hot_sums)
        for _, found in _partitions(batches):
            rows: list[tuple] = []
            known = [unpack(p) for kind, _, p in found if kind == "histories"]
            names, alpha, count = np.empty(0, np.uint64), np.empty(0), np.empty(0)
            if known:
                stacked = np.concatenate([k[0] for k in known])
                values = np.concatenate([np.stack(k[1:], axis=1) for k in known])
                order = np.argsort(stacked, kind="stable")
                names, heads = np.unique(stacked[order], return_index=True)
                alpha, count = model.alpha(np.add.reduceat(values[order], heads, axis=0))
            asked = [unpack(p) for kind, _, p in found if kind == "asked"]
            if not asked:
                continue
            history, doc, seen, grp = (np.concatenate([p[j] for p in asked]) for j in range(4))
            often, at = Frequent.place(table.words, history), Frequent.place(names, history)
            a, c = np.ones(len(history)), np.zeros(len(history))
            a[at >= 0], c[at >= 0] = alpha[at[at >= 0]], count[at[at >= 0]]
            a[often >= 0], c[often >= 0] = hot_alpha[often[often >= 0]], hot_count[often[often >= 0]]
            part = _units(np.where(seen > 0, -np.log10(c + 1), np.log10(a)))
            order = np.argsort(grp, kind="stable")
            groups, heads = np.unique(grp[order], return_index=True)
            for g, own in zip(groups.tolist(), np.split(order, heads[1:])):
                sums = np.zeros((int(doc[own].max()) + 1, COLUMNS), np.int64)
                np.add.at(sums[:, HISTORY], doc[own], part[own])
                _by_document(rows, sums, g)
            if rows:
                yield _rows(rows)
    return run


def _finish(model_shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_shared.value[0]
        for _, found in _partitions(batches):
            ids, known, held, n = next(unpack(p) for kind, _, p in found if kind == "keys")
            sums = np.zeros((len(ids), COLUMNS), np.int64)
            for payload in (p for kind, _, p in found if kind == "documents"):
                some, *columns = unpack(payload)
                sums[some] += np.stack(columns, axis=1)
            held = held.astype(bool)
            base, score = model.scores(sums, n, held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=known == 0), pa.array(held), pa.array(n), pa.array(sums[:, KNOWN]),
                 pa.array(np.full(len(ids), model.tokens)), pa.array(base), pa.array(score)],
                names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def _to_targets(frame: DataFrame) -> DataFrame:
    return frame.repartition("target").sortWithinPartitions("target")


def katz_scores(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Learns from the rows whose crc32(key as text) mod 7 is not 2; a row with a null key is a training row.  A null text is
    empty and has the end token alone; repeated rows are learnt from and scored each.  With nothing to learn from, every
    token is unknown.  Only the two columns are read.  `sample_documents` bounds the sample that proposes frequent words
    and pairs; their counts, like all others, come from the whole corpus, and results do not depend on the proposal.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias(key), text)
    table = frequent_table(rows, text, sample_documents)
    shared = spark.sparkContext.broadcast(table)  # a few thousand keys and counts
    entries = table.tokens * FOLDS // (FOLDS - 1) + 1
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, entries // BUCKET_ENTRIES, min(partitions, entries // 100_000))
    dealt = rows.mapInArrow(_deal(shared, text, buckets), SCHEMA).drop("numbers")
    counted = written(_to_targets(dealt).mapInArrow(_count_words(shared, buckets), SCHEMA), "word-sums")

    size = 2 * (LARGE + 1) + 1
    total = counted.where("kind = 'totals'").agg(*[F.coalesce(F.sum(F.col("numbers")[i]), F.lit(0)) for i in range(size)]).first()
    total = np.array([int(x) for x in total], np.int64)
    tally = lambda x: np.bincount(np.minimum(x, LARGE + 2), minlength=LARGE + 3)[1:LARGE + 2]
    total[:LARGE + 1] += tally(table.pair_counts)
    total[LARGE + 1:-1] += tally(table.word_counts)
    model = Model(total[:LARGE + 1].tolist(), total[LARGE + 1:-1].tolist(), table.tokens, int(total[-1] + (table.word_counts > 0).sum()))
    often = np.zeros((len(table.words), SUMS), np.int64)  # as many rows as the table has words
    for r in counted.where("kind = 'frequent'").groupBy("target").agg(*[F.sum(F.col("numbers")[i]).alias(f"n{i}") for i in range(SUMS)]).collect():
        often[r["target"]] = r[1:]
    some = np.flatnonzero(table.pair_counts)
    often += history_sums(Frequent.place(table.words, table.pair_history)[some], len(often), table.pair_counts[some],
                          table.word_counts[Frequent.place(table.words, table.pair_word)[some]])
    model_shared = spark.sparkContext.broadcast((model, often))

    asked = counted.where("kind in ('asked', 'histories')").drop("numbers")
    answered = _to_targets(asked).mapInArrow(_ask_histories(shared, model_shared), SCHEMA).drop("numbers")
    gathered = counted.where("kind in ('documents', 'keys')").drop("numbers").unionByName(answered)
    return _to_targets(gathered).mapInArrow(
        _finish(model_shared, key), f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double")
