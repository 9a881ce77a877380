"""What the steps of the pipeline hold beside an Arrow batch that holds all texts of a task."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from adspectra.llm import packing, quality, simhash
from adspectra.llm.common import parts
from adspectra.llm.queries import vocabulary

ROWS, WORDS = 6000, 250
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


class Captured:
    """Stands for a table; hands out the function that a step would run on its batches."""

    schema, columns = SCHEMA, SCHEMA.names

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        return function


@pytest.fixture(scope="module")
def batch():
    rnd = np.random.default_rng(7)
    words = np.array(["".join(rnd.choice(list("abcdefghij"), 6)) for _ in range(3000)])
    texts = [" ".join(words[rnd.integers(0, len(words), WORDS)]) for _ in range(ROWS - 2)]
    return pa.RecordBatch.from_arrays([pa.array(range(ROWS)), pa.array([*texts, None, ""], pa.string())], SCHEMA.names)


def peak_of(step, batch) -> tuple[float, list]:
    """MB that Python and numpy hold at most, and the result's batches."""
    list(step(iter([batch.slice(0, 2)])))  # tables of the worker
    tracemalloc.start()
    try:
        out = list(step(iter([batch])))
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_parts_hold_every_row_once(batch):
    got = list(parts(iter([batch, batch.slice(0, 0), batch.slice(5, 300)]), 256))
    assert max(x.num_rows for x in got) <= 256
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch, batch.slice(5, 300)]).replace_schema_metadata(None))


@pytest.mark.parametrize(
    ("step", "most"),
    [
        (quality.keep(Captured(), quality.Model()), 6),
        (simhash.fingerprints(Captured()), 6),
        (packing.token_pieces(Captured(), vocabulary("word_bpe_49k.json")), 60),
    ],
    ids=["quality_rules", "simhash_near_dedup", "best_fit_packing"],
)
def test_a_step_does_not_hold_what_it_makes_of_a_whole_batch(batch, step, most):
    held, out = peak_of(step, batch)
    assert held < most
    whole, cut = pa.Table.from_batches(out), pa.Table.from_batches([x for k in range(0, ROWS, 100) for x in step(iter([batch.slice(k, 100)]))])
    assert whole.equals(cut)
    assert len(whole) >= ROWS - 2
