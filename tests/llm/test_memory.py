"""What a Python worker holds doesn't grow with its batches."""

import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from codelode.llm import near_dedup, packing, sentence_dedup
from codelode.llm.flat import sliced


class Caught:
    """Stands for a table, and keeps the function that goes to the workers."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def batch_of(rows: int) -> pa.RecordBatch:
    texts = [" ".join(f"w{(i * 7 + j) % 5000}" for j in range(700)) for i in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(texts)], ["doc_id", "text"])


def test_slices_are_whole_and_small():
    texts = ["a" * 10, None, "", "b" * 50, "é" * 4, "c"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(sliced([batch, batch.slice(0, 0)], most=20))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 20 for p in parts)


@pytest.mark.parametrize("step", [lambda d: near_dedup._sampled(d, 5, 8), lambda d: sentence_dedup._span_rows(d, 12, 20, 40, ("h1", "doc_id"))], ids=["near", "sentences"])
def test_worker_holds_no_whole_batch(step):
    run, peaks = step(Caught()).run, []
    batches = [batch_of(2000), batch_of(8000)]
    for batch in batches:
        list(run(iter([batch_of(100)])))
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.25 * peaks[0]


def test_packing_plan_needs_no_python_rows(spark):
    docs = spark.createDataFrame(pa.table({"doc_id": [1, 2], "text": ["some words", None]}))
    packed = packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert "applySchemaToPythonRDD" not in (plan := packed._jdf.queryExecution().toString()) and "LocalRelation" in plan
    assert packed.count() == 2
    assert packing.best_fit(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
