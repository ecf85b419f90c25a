"""Token ids in files of wavelet matrices: succinct bit planes with rank and select.

File format: a Parquet table; every file is a shard, a range of keys in ascending order, every row a block of whole
documents.  A block has `n` ids below 2**`bits`.  `planes` holds the bit planes from the highest bit, each packed to
whole bytes; at every plane the zeros of the sequence come before the ones, in order, for the next plane; `zeros` counts
them.  `ranks` holds for each plane the number of ones before every STEP bits.  `keys` and `lengths` list the
documents, `before` counts the shard's ids before the block.  Access, counting and occurrence lookup need one block.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vacantia.llm import shared, words

BLOCK_TOKENS = 1 << 18
STEP = 512
END_ID = 1
SLICE = 1 << 20
CACHE_WORDS = 3_000_000  # some 50 bytes each
GROUP = 1000
MERGE = 4
FRONT = 19  # bits of the hash that choose a place in front of the cache
HASHED = 1 << 15  # bytes hashed at once, so that a processor's cache holds them
WARM_WORDS = 1 << 19
WARM_DOCUMENTS = 20_000
BROADCAST_SHARDS = 1_000_000
SCHEMA = ("shard long, block long, before long, n long, bits int, zeros array<long>, planes binary, ranks binary,"
          " keys array<long>, lengths array<long>")
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,!?;:")] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
# Runs of these letters, a to z and \xdf to \xff in UTF-8, are left as they are by NFC and lower case and never cut.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_BYTE_LEVEL = np.arange(256, dtype="<u4")  # the letters that stand for bytes, as in ByteLevel
_BYTE_LEVEL[0x80:0xA1] += 0xA2
_BYTE_LEVEL[0xAD] = 0x143
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """A sequence of ids: `access`, `rank` (occurrences before a place) and `select` (place of an occurrence)."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: bytes, ranks: bytes):
        self.n, self.bits, self.zeros = n, bits, zeros
        self.planes = np.frombuffer(planes, np.uint8).reshape(bits, -1)
        self.ranks = np.frombuffer(ranks, "<u4").reshape(bits, -1)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, zeros, planes, ranks = len(ids), [], [], []
        row = np.asarray(ids)
        for b in range(bits - 1, -1, -1):
            one = ((row >> b) & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            counts = np.bitwise_count(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
            per_step = np.add.reduceat(counts, np.arange(0, len(counts), STEP // 64), dtype=np.uint32) if n else []
            ranks.append(np.concatenate([[0], np.cumsum(per_step)]).astype("<u4"))
            planes.append(packed)
            zeros.append(n - int(ranks[-1][-1]))
            below = np.empty_like(row)
            np.take(row, np.flatnonzero(~one), out=below[:zeros[-1]])
            np.take(row, np.flatnonzero(one), out=below[zeros[-1]:])
            row = below
        return cls(n, bits, zeros, np.concatenate(planes).tobytes(), np.concatenate(ranks).tobytes())

    def _ones(self, level: int, at: int) -> int:
        step = at // STEP
        part = self.planes[level, step * STEP // 8:at // 8]
        rest = int(self.planes[level, at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(self.ranks[level, step]) + int(_BITS[part].sum()) + int(_BITS[rest])

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level, at // 8]) >> at % 8 & 1

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _descend(self, token: int, at: int) -> tuple[int, int]:
        low = 0
        for level in range(self.bits):
            if token >> (self.bits - 1 - level) & 1:
                low, at = (self.zeros[level] + self._ones(level, x) for x in (low, at))
            else:
                low, at = (x - self._ones(level, x) for x in (low, at))
        return low, at

    def rank(self, token: int, at: int | None = None) -> int:
        """Occurrences of a token before place `at` (all by default)."""
        if token >> self.bits:
            return 0
        low, high = self._descend(token, self.n if at is None else min(at, self.n))
        return high - low

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this kind in a plane."""
        starts = self.ranks[level].astype(np.int64)
        if not bit:
            starts = np.minimum(np.arange(len(starts)) * STEP, self.n) - starts
        step = int(np.searchsorted(starts, k, side="right")) - 1
        unpacked = np.unpackbits(self.planes[level, step * STEP // 8:(step + 1) * STEP // 8], bitorder="little")
        return step * STEP + int(np.flatnonzero(unpacked == bit)[k - int(starts[step])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of a token."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        at = self._descend(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        row = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(row)
            z = self.zeros[level]
            above[np.flatnonzero(~one)] = row[:z]
            above[np.flatnonzero(one)] = row[z:] | (1 << (self.bits - 1 - level))
            row = above
        return row


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Starts, ends and hashes of the parts that are encoded alone, each text's first part, and the joined texts.

    Parts are words, cut before a mark that follows an ASCII letter or digit, where the tokenizer cuts too.  The
    tokenizer ignores case, so ASCII letters are lowered, unless something like a special token is among the texts.
    """
    data = b"\n".join(texts)
    data = data if b"<|" in data else data.lower()
    buf = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(words.SPACE[buf], prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    cuts = np.flatnonzero(_MARK[buf[1:]])
    cuts = cuts[_ALNUM[buf[cuts]]] + 1
    if len(cuts):
        word_starts = starts
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.minimum(np.append(starts[1:], len(buf)), ends[np.searchsorted(word_starts, starts, side="right") - 1])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return starts, ends, _hashes(buf, starts), np.searchsorted(starts, offsets), data


def _hashes(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """`words.hash_runs` of some HASHED bytes at a time; a longer part is hashed whole."""
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(buf), HASHED)))
    bounds = [*starts[cuts[cuts < len(starts)]].tolist(), len(buf)]
    parts = [words.hash_runs(buf[a:b], starts[i:j] - a, words.WORD_VALUES)
             for a, b, i, j in zip(bounds, bounds[1:], cuts.tolist(), [*cuts[1:].tolist(), len(starts)])]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _plain_letters(tokenizer) -> bool:
    """Whether the parts of a tokenizer are such that a run of _LETTERS is one piece, unchanged but for the letters of its bytes."""
    def steps(part, name: str) -> list[dict]:
        found = json.loads(part.__getstate__()) if part is not None else {"type": None}
        return found[name] if found["type"] == "Sequence" else [found]

    normal = steps(tokenizer.normalizer, "normalizers")
    cut = steps(tokenizer.pre_tokenizer, "pretokenizers")
    model = tokenizer.model
    return (all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"}) for n in normal)
            and [c["type"] for c in cut] == ["Split", "ByteLevel"]
            and cut[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"} and cut[0]["invert"]
            and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
            and type(model).__name__ == "BPE" and bool(model.end_of_word_suffix) and not model.dropout and not model.continuing_subword_prefix)


_encoders: dict[str, WordEncoder] = {}


def worker_encoder(path: str, warm=None) -> WordEncoder:
    """The encoder of this Python worker, kept with its cache between tasks; `warm` holds words that a new one starts with."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
        if warm is not None:
            _encoders[path].start_with(*warm.value)
    return _encoders[path]


def _sample_words(text: str):
    """The distinct words of each slice, as the encoder cuts them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in words.slices(batch, text, SLICE):
                starts, ends, hashes, _, data = pieces(texts)
                _, one, often = np.unique(hashes, return_index=True, return_counts=True)
                found = [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(often)], names=["word", "n"])
    return run


def _encoded_words(tokenizer_path: str):
    """Hashes, numbers of ids and ids of the words of each batch, packed to one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder(tokenizer_path)
        for batch in batches:
            found = batch.column(0).to_pylist()
            if not found:
                continue
            ids, sizes = encoder._encode_new(found)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            keys = words.hash_runs(np.frombuffer(b"".join(found), np.uint8), np.cumsum(lengths) - lengths, words.WORD_VALUES)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, sizes, ids)], names=["keys", "sizes", "ids"])
    return run


def warm_words(docs: DataFrame, text: str, tokenizer_path: str, most: int = WARM_WORDS, sample_documents: int = WARM_DOCUMENTS):
    """A broadcast of the ids of at most `most` words, the most frequent of a sample, each encoded once; results do not depend on it.

    Every worker would otherwise encode them itself.  Some 30 bytes a word.
    """
    spark = docs.sparkSession
    share = min(1.0, sample_documents / max(docs.count(), 1))
    counted = docs.select(text).sample(share, 7).mapInArrow(_sample_words(text), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = counted.where("n > 1 AND position('<|', cast(word AS string)) = 0").orderBy(F.desc("n"), "word").limit(most).select("word")
    rows = often.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_encoded_words(tokenizer_path), "keys binary, sizes binary, ids binary").collect()
    keys, sizes, ids = (np.concatenate([np.empty(0, kind), *(np.frombuffer(r[i], kind) for r in rows)]) for i, kind in enumerate((np.uint64, np.int64, np.uint32)))
    return spark.sparkContext.broadcast((keys, sizes.astype(np.uint16), ids))


class WordEncoder:
    """Ids of whole texts through a bounded cache of words.

    Exact for tokenizers that ignore case, drop white space, never join across it and split letters from marks.  Words are looked up by their 64-bit
    hash, frequent ones at once, each distinct one of the others once in a slice.
    """

    def __init__(self, tokenizer_path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cache_words = cache_words
        self._clear()
        # Any special token in `<| |>` will do; it is matched before anything else and never joined to its neighbours.
        special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content.startswith("<|"))
        self.between, self.between_id = special[0].encode(), self.tokenizer.token_to_id(special[0])
        self.letters = None
        if _plain_letters(self.tokenizer):
            from tokenizers.pre_tokenizers import WhitespaceSplit

            self.letters = Tokenizer(self.tokenizer.model)  # the same merges without normaliser and patterns
            self.letters.pre_tokenizer = WhitespaceSplit()
            end = self.tokenizer.model.end_of_word_suffix
            self.last = np.fromiter(((self.letters.id_to_token(i) or "").endswith(end) for i in range(self.letters.get_vocab_size())), bool)  # the ids that end a word

    def _clear(self) -> None:
        """The cache: runs of sorted word hashes, where in `flat` the ids of each begin and how many there are.

        Each run is over MERGE times as long as the next, so a word is copied a few times only as the cache grows.
        """
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.flat = np.empty(0, np.uint32)
        # In front of the runs, the first word for each place: its hash, begin and number of ids (none: -1).
        self.front = (np.zeros(1 << FRONT, np.uint64), np.full(1 << FRONT, -1), np.zeros(1 << FRONT, np.int32))

    def _to_front(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Words, the most frequent ones first, to the places that are still free."""
        place = (keys >> np.uint64(64 - FRONT)).astype(np.int64)
        free = np.flatnonzero(self.front[1][place] < 0)[::-1]
        for held, values in zip(self.front, (keys, begin, size)):
            held[place[free]] = values[free]

    def start_with(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Words encoded elsewhere: their hashes, numbers of ids, and ids."""
        order = np.argsort(keys)
        sizes = sizes.astype(np.int64)
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids])
        if len(keys):
            self._to_front(keys, begin, sizes)
            self._add(keys[order], begin[order], sizes[order])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of the ids of each word; begin is -1 for unknown ones."""
        begin, size = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        missing = np.arange(len(keys))
        for known, begins, sizes in self.runs:
            at = np.minimum(np.searchsorted(known, keys[missing]), len(known) - 1)
            hit = known[at] == keys[missing]
            begin[missing[hit]], size[missing[hit]] = begins[at[hit]], sizes[at[hit]]
            missing = missing[~hit]
        return begin, size

    def _add(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        self.runs.append((keys, begin, size))
        while len(self.runs) > 1 and MERGE * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            last, before = self.runs.pop(), self.runs.pop()
            order = np.argsort(np.concatenate([before[0], last[0]]), kind="stable")  # two sorted runs: a merge
            self.runs.append(tuple(np.concatenate([x, y])[order] for x, y in zip(before, last)))

    def _encode_new(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers; runs of common letters skip the steps of the tokenizer that change nothing in them."""
        if self.letters is None:
            return self._encode_any(new)
        plain = np.fromiter((_LETTERS.fullmatch(w) is not None for w in new), bool, len(new))
        parts, sizes = [], np.zeros(len(new), np.int64)
        for which, encode in ((plain, self._encode_letters), (~plain, self._encode_any)):
            if which.any():
                ids, sizes[which] = encode([w for w, mine in zip(new, which.tolist()) if mine])
                parts.append((which, ids))
        ends = np.cumsum(sizes)
        found = np.empty(int(ends[-1]) if len(new) else 0, np.uint32)
        for which, ids in parts:
            found[words.ragged((ends - sizes)[which], sizes[which])] = ids
        return found, sizes

    def _encode_letters(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of runs of _LETTERS."""
        groups = [np.frombuffer(b" ".join(new[i:i + GROUP]), np.uint8) for i in range(0, len(new), GROUP)]
        texts = [_BYTE_LEVEL[g].tobytes().decode("utf-32-le") for g in groups]
        found = self.letters.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        return (ids, sizes) if len(sizes) == len(new) else self._encode_any(new)  # letters that the model lacks

    def _encode_any(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers, encoding many words at a time with a special token between them."""
        if any(b"<|" in w for w in new):  # a word may hold special tokens itself
            found = [self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in new]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        groups = [new[i:i + GROUP] for i in range(0, len(new), GROUP)]
        texts = [self.between.join(g).decode() for g in groups]
        ids, sizes = [], []
        for g, x in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = np.array(x.ids, np.uint32)
            cuts = np.flatnonzero(own == self.between_id)
            if len(cuts) != len(g) - 1:
                raise ValueError("the separating token was not kept apart")
            sizes.append(np.diff(cuts, prepend=-1, append=len(own)) - 1)
            ids.append(np.delete(own, cuts))
        return np.concatenate(ids), np.concatenate(sizes)

    def _of_words(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of the ids of words of `data`; each distinct one that is unknown is encoded once."""
        keys, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        begin, size = self._find(keys)
        new = np.flatnonzero(begin < 0)
        if len(new):
            ids, sizes = self._encode_new([data[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist())])
            begin[new], size[new] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
            self.flat = np.concatenate([self.flat, ids])
            self._add(keys[new], begin[new], sizes)
            self._to_front(keys[new], begin[new], sizes)
        return begin[back], size[back]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and the number of each text."""
        starts, ends, hashes, first, data = pieces(texts)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        place = hashes >> np.uint64(64 - FRONT)
        begin = np.where(self.front[0][place] == hashes, self.front[1][place], -1)
        size = self.front[2][place].astype(np.int64)
        rest = np.flatnonzero(begin < 0)
        if sum(len(r[0]) for r in self.runs) > self.cache_words and len(rest):
            unknown = self._find(np.unique(hashes[rest]))[0] < 0
            if unknown.any():
                self._clear()
                rest = np.arange(len(hashes))
        begin[rest], size[rest] = self._of_words(hashes[rest], starts[rest], ends[rest], data)
        sums = np.concatenate([[0], np.cumsum(size)])
        return self.flat[words.ragged(begin, size)], np.diff(sums[first])


def _write_blocks(tokenizer_path: str, warm, bits: int, key: str, text: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, shard, block, before = worker_encoder(tokenizer_path, warm), TaskContext.get().partitionId(), 0, 0
        keys, lengths, ids = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, keys, lengths, ids
            m = WaveletMatrix.build(np.concatenate(ids).astype(np.uint16 if bits <= 16 else np.uint32), bits)
            row = {"shard": shard, "block": block, "before": before, "n": m.n, "bits": bits, "zeros": m.zeros,
                   "planes": m.planes.tobytes(), "ranks": m.ranks.tobytes(), "keys": keys, "lengths": lengths}
            block, before = block + 1, before + m.n
            keys, lengths, ids = [], [], []
            types = {"bits": pa.int32(), "zeros": pa.list_(pa.int64()), "planes": pa.binary(), "ranks": pa.binary(),
                     "keys": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.int64())) for k, v in row.items()], names=list(row))

        held = 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for at, texts in words.slices(batch, text, SLICE):
                coded, counts = encoder.encode(texts)
                ends = np.cumsum(counts)
                coded = np.insert(coded, ends, end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                i = 0
                while i < len(texts):
                    done = int(ends[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, done + block_tokens - held, side="right")))
                    ids.append(coded[done:ends[j - 1]])
                    keys += own[at + i:at + j]
                    lengths += counts[i:j].tolist()
                    held += int(ends[j - 1]) - done
                    if j < len(texts) or held >= block_tokens:
                        yield flush()
                        held = 0
                    i = j
        if keys:
            yield flush()
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, key: str = "doc_id", text: str = "text",
                      end_id: int = END_ID, partitions: int | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes whole texts (null: empty), each with `end_id` behind it, and writes them in ascending key order.

    Ranges of keys are the shards; null keys come first, repeated keys are neighbours, an empty table gives no block.
    A block has about `block_tokens` ids, or one longer document.  Other columns are not read.
    """
    from tokenizers import Tokenizer

    bits = max(1, (max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1, end_id)).bit_length())
    rows = docs.select(key, text)
    ordered = (rows.repartitionByRange(partitions, key) if partitions else rows.repartitionByRange(key)).sortWithinPartitions(key)
    blocks = ordered.mapInArrow(_write_blocks(tokenizer_path, warm_words(docs, text, tokenizer_path), bits, key, text, end_id, block_tokens), SCHEMA)
    blocks.write.option("compression", "zstd").parquet(folder)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            value = {k: v[i].as_py() for k, v in columns.items()}
            m = WaveletMatrix(value["n"], value["bits"], value["zeros"], value["planes"], value["ranks"])
            ids = m.decode().astype("<u4")
            lengths = np.array(value["lengths"], np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(value["keys"], pa.int64()), "start": pa.array(value["start"] + ends - lengths, pa.int64()),
                "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def blocks_with_start(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of the files with `start`, the number of ids before each; only a row per shard is ordered."""
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("_n"))
    starts = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_start"))
    count = len(spark.read.parquet(folder).inputFiles())  # a file is a shard; 16 bytes each are broadcast up to the bound
    starts = F.broadcast(starts) if count <= BROADCAST_SHARDS else starts
    return blocks.join(starts, "shard").withColumn("start", F.col("_start") + F.col("before")).drop("_start")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    used = blocks_with_start(spark, folder).select("start", "n", "bits", "zeros", "planes", "ranks", "keys", "lengths")
    return used.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the files in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = shared.shared_folder(spark, "token-ids")
    write_token_files(docs, folder, tokenizer_path, **options)
    return token_digests(spark, folder)
