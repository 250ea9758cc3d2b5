"""Batches of matrices are not copied as a whole into Python."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from bindery.functions.vectors import best_of_blocks, matrix_of


def test_blocks_are_met_row_by_row():
    """64 rows of two matrices of 256 kB: before, all 32 MB were copied at once, with the lists of all ids."""
    rng = np.random.default_rng(1)
    blocks = [rng.normal(size=(1024, 64)).astype("float32") for _ in range(64)]
    asked = [rng.normal(size=(1024, 64)).astype("float32") for _ in range(64)]
    ids = [list(range(i * 1024, (i + 1) * 1024)) for i in range(64)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([b.tobytes() for b in blocks]), pa.array([64] * 64, pa.int32()), pa.array(ids),
                                        pa.array([a.tobytes() for a in asked]), pa.array([64] * 64, pa.int32())], names=["ids", "matrix", "dim", "q_ids", "q_matrix", "q_dim"])
    run = best_of_blocks(2, -1e9, 7, pa.int64(), pa.int64())
    tracemalloc.start()
    n = 0
    for at, out in enumerate(run([batch.slice(3)])):
        n += out.num_rows
        if at == 0:
            q, scores = asked[3][0].astype("float64"), blocks[3].astype("float64")
            best = np.argsort(-np.round(scores @ q, 7), kind="stable")[:2]
            assert out.column("query_id")[0].as_py() == 3 * 1024 and out.column("chunk_id").to_pylist()[:2] == (best + 3 * 1024).tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 61 * 1024 * 2 and peak < 24e6


@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()])
def test_matrix_of_like_stack(kind):
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=(n, 5)).astype("float32") for n in (3, 1, 0, 4, 2)]
    made = pa.array([r.tolist() for r in rows], pa.list_(pa.list_(kind)))
    assert matrix_of.func(made).to_pylist() == [r.tobytes() for r in rows]
    assert matrix_of.func(made.slice(1, 3)).to_pylist() == [r.tobytes() for r in rows[1:4]]
    assert matrix_of.func(made.slice(0, 0)).to_pylist() == []
    with pytest.raises(ValueError):
        matrix_of.func(pa.array([[[1.0, 2.0], [1.0]]], pa.list_(pa.list_(kind))))
