import pandas as pd

from leafloom.functions import chunking
from leafloom.plans import catalog


def test_leaves_leave_in_bounded_frames():
    """Before: one frame for all leaves of a batch of texts."""
    text = "\n\n".join(f"Sentence {k} of a text. " * 30 for k in range(300))
    out = list(chunking.leaf_frames(pd.DataFrame({"doc_id": range(20), "text": [text] * 20}), "doc_id", "text"))
    assert len(out) > 1 and max(map(len, out)) <= chunking.FRAME_ROWS
    whole = [(i, k, *leaf) for i in range(20) for k, leaf in enumerate(chunking.chunk(text))]
    assert [tuple(r) for f in out for r in f.itertuples(index=False)] == whole


def test_workers_get_bounded_batches(spark, sf):
    """Before: 10,000 texts at once, whatever their length."""
    size = "spark.sql.execution.arrow.max{}PerBatch"
    spark.conf.set(size.format("Records"), "10000")
    spark.conf.unset(size.format("Bytes"))
    assert catalog.queries()["normalise_checks"](spark, sf).where("not settled").count() == 0
    assert spark.conf.get(size.format("Records")) == "1000" and spark.conf.get(size.format("Bytes")) == str(8 << 20)
