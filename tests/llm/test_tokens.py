"""Token counts and token files against the libraries themselves."""

import zlib

import numpy as np
import pytest

from vacantia.llm import queries, token_counts, wavelet

SCHEMA = "doc_id long, text string, n_tokens string, start string"
TEXTS = [
    None, "", " ", "  a  B   ", "a▁b ▁ c", "x\0y z", "\n\n a \t b\r\n", "é　x ½ ﬁ 日本語 Σας ΑΣ", "<s> a </s> <|endoftext|>b it's é ́x İ",
    "the of and " * 4000, "word" * 3000, "tail   ", "one\x0btwo\x0cthree",
]


@pytest.fixture
def docs(frame):
    rows = [(i, t, "", "") for i, t in enumerate(TEXTS)]
    return frame([*rows, (None, "a null key", "", ""), (3, "again a key", "", ""), (3, "again a key", "", "")], SCHEMA).repartition(3)


def test_counts_equal_the_library(spark, frame, docs):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for options in ({}, {"frequent": 4, "cache_entries": 2}):
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, path, **options).collect()), key=str)
        expected = []
        for r in docs.collect():
            text = r["text"] or ""
            n = len(library.encode(text))
            expected.append((r["doc_id"], len(text.encode()), n, n > 4096))
        assert got == sorted(expected, key=str)
    assert token_counts.token_counts(frame([], SCHEMA), path).collect() == []


def test_length_table_finds_all_it_keeps():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 63, 5000, dtype=np.uint64)
    table = token_counts.LengthTable(keys, np.arange(1, 5001), probes=40)
    assert (table.find(keys) == np.arange(1, 5001)).all()
    assert not table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)].any()


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 1000).astype(np.uint16)
    m = wavelet.WaveletMatrix.build(ids, 10)
    assert (m.decode() == ids).all()
    for i in range(0, n, max(1, n // 30)):
        token = int(ids[i])
        assert m.access(i) == token
        assert m.rank(token, i) == (ids[:i] == token).sum()
        assert m.select(token, m.rank(token, i)) == i
    assert m.rank(999) == (ids == 999).sum()
    with pytest.raises(IndexError):
        m.select(1023, 0)


@pytest.mark.parametrize("options", [{}, {"block_tokens": 50, "partitions": 3}])
def test_files_round_trip(spark, frame, docs, options):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = [tuple(r) for r in wavelet.encode_and_read(docs, path, **options).collect()]
    start, expected = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        expected.append([r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())])
        start += len(ids)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == [r[0] for r in expected]
    assert [r[1] for r in by_start] == list(np.cumsum([0, *[r[2] for r in by_start]])[:-1])
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in expected)
    assert wavelet.encode_and_read(frame([], SCHEMA), path).collect() == []


def test_occurrence_lookup_in_the_file(spark, frame):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    folder = wavelet.shared.shared_folder(spark, "lookup")
    wavelet.write_token_files(frame([(1, "a b a", "", ""), (2, "b a", "", "")], SCHEMA), folder, path, partitions=1)
    row = spark.read.parquet(folder).collect()[0]
    m = wavelet.WaveletMatrix(row["n"], row["bits"], row["zeros"], bytes(row["planes"]), bytes(row["ranks"]))
    a = Tokenizer.from_file(path).encode("a", add_special_tokens=False).ids[0]
    assert m.rank(a) == 3 and [m.select(a, k) for k in range(3)] == [0, 2, 5]


def test_runs_of_common_letters_are_encoded_without_the_steps_that_leave_them():
    import random

    encoder = wavelet.WordEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    assert encoder.letters is not None
    random.seed(5)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(i) for i in range(0xDF, 0x100) if i != 0xF7)
    new = ["".join(random.choices(letters, k=random.randint(1, 14))).encode() for _ in range(3000)] + [b"x1", "Ü".encode(), "÷".encode(), b"don't", "日本".encode()]
    asked = []
    encoder._encode_any = lambda some, whole=encoder._encode_any: asked.extend(some) or whole(some)
    ids, sizes = encoder._encode_new(new)
    assert asked == new[3000:]
    ends = np.cumsum(sizes)
    want = [encoder.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in new]
    assert [ids[b - n:b].tolist() for b, n in zip(ends.tolist(), sizes.tolist())] == want


def test_frequent_words_are_found_without_sorting_the_slice(monkeypatch):
    texts = [b"the quick fox, the end", b"", b"The zebra. " * 50, "über ".encode() * 3 + b"<|endoftext|> the"]
    encoder = wavelet.WordEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    first = encoder.encode(texts)
    sorted_words = []
    monkeypatch.setattr(encoder, "_of_words", lambda hashes, *rest, whole=encoder._of_words: sorted_words.append(len(hashes)) or whole(hashes, *rest))
    again = encoder.encode(texts)
    assert sum(sorted_words) == 0
    want = [encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    for ids, sizes in (first, again):
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
