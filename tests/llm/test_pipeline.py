"""The corpus pipeline against its stages worked out plainly, and the registration of all queries."""

import collections
import zlib

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from vacantia.llm import decontaminate, mixing, queries, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]


def test_pipeline_equals_plain_steps(spark):
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.classify(docs, labels).where("toxic").collect()}
    left = docs.where(~docs["doc_id"].isin(list(bad)))
    classes = {r["doc_id"]: r["class_id"] for r in queries.order_minhash.near_duplicates(left).collect()}
    items = [decontaminate.normalized(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = []
    for r in left.collect():
        if classes[r["doc_id"]] != r["doc_id"]:
            continue
        text = decontaminate.normalized(r["text"])
        near = any(decontaminate.best_end(len(t), decontaminate.masks(t), text)[0] <= decontaminate.budget(len(t), decontaminate.ERROR_SHARE)
                   for t in items if t)
        if not near:
            clean.append(r)
    stage = spark.createDataFrame(clean, docs.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(stage).collect()}
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    expected, start = [], 0
    for r in sorted(clean, key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"], add_special_tokens=False).ids + [1]
        for _ in range(copies[r["doc_id"]]):
            expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert collections.Counter(map(tuple, got)) == collections.Counter(expected)
