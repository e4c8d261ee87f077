"""The product of parts of vectors with blocks of queries, in the cells where a query looks."""

import numpy as np
import pyarrow as pa

from draftlake.operators import retrieval as R


def test_best_in_probed_cells_as_all_scores(monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "VECTOR_PART", 16)
    r = np.random.default_rng(1)
    v, q = r.normal(size=(100, 4)), r.normal(size=(20, 4))
    # Copies: ties go by chunk.
    v[50:] = v[:50]
    cell = np.arange(100) % 3
    look = lambda x: np.stack([x[:, 0] > 0, x[:, 0] <= 0, x[:, 1] > 0], axis=1)
    lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    vectors = pa.table({"chunk_id": np.arange(100), "cell": cell, "v": lists(v)})
    got = R._best_vectors(vectors, pa.table({"query_id": np.arange(20), "q": lists(q)}), 6, look).to_pylist()
    for i in range(20):
        score = np.round(v @ q[i], 6)
        open_ = [c for c in range(100) if look(q[i : i + 1])[0, cell[c]]]
        assert [x["chunk_id"] for x in got if x["query_id"] == i] == sorted(open_, key=lambda c: (-score[c], c))[:6]
