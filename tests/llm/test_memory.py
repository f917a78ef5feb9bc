"""What a Python worker and the executor beside it hold."""

import tracemalloc

import corpus_pipeline
import numpy as np
from harborline.llm.tokens import Memory


def test_remembered_pieces_take_few_bytes_each():
    """Every worker of an executor has its own memory; objects in a dictionary took over 100 bytes a piece."""
    words = [f"{w:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for w in range(1 << 20, (1 << 20) + 100_000)]
    raw = " ".join(words).encode()
    memory = Memory(lambda texts: [[len(t), 7] for t in texts])
    tracemalloc.start()
    ids, at = memory.ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    del ids, at
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60 * len(words) + (17 << 20)  # and two tables of powers, 8 MB each, kept by the hashes
    again, at = memory.ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert again.tolist() == [x for w in words for x in (len(w), 7)] and at.tolist() == [0, 2 * len(words)]
    memory.bound = 10
    fresh, _ = memory.ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert fresh.tolist() == again.tolist()


def test_stages_bound_the_bytes_of_a_batch(spark):
    name, _ = corpus_pipeline.BATCH
    before = spark.conf.get(name)
    try:
        corpus_pipeline.packing(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
        docs = spark.range(0, 3_000, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 10000) AS text")
        sizes = docs.mapInArrow(lambda batches: (type(b).from_arrays([b.column("id").slice(0, 1)], ["n"]) for b in batches), "n long").count()
        assert sizes >= 7  # 30 MB; in one batch before
    finally:
        spark.conf.set(name, before)
