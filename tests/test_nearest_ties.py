import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from clausewright.operators import retrieve


def test_ties_beyond_the_kth_go_to_the_smallest_ids(spark):
    rng = random.Random(3)
    common = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(k, common if k % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)]) for k in range(600)]
    rng.shuffle(rows)
    queries = [(1, common), (2, [x + 0.1 for x in common]), (3, [0.0] * 8)]
    got = retrieve.nearest(spark.createDataFrame(queries, "query_id bigint, vector array<double>"), spark.createDataFrame(rows, "id bigint, vector array<double>"), k=8).collect()
    for q, v in queries:
        brute = sorted((math.dist(v, x), i) for i, x in rows)
        same = [i for d, i in brute if abs(d - brute[0][0]) < 1e-12]
        want = sorted(same)[:8] if len(same) >= 8 else [i for _, i in brute[:8]]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_a_large_block_is_compared_slice_by_slice(monkeypatch):
    rng = np.random.default_rng(5)
    made = lambda n, names: pa.table({names[0]: np.arange(n), names[1]: pa.array(list(np.round(rng.normal(size=(n, 4)), 1)), pa.list_(pa.float64()))})
    held, rows = made(2048, ("query_id", "q")), made(8192, ("id", "v"))
    run = retrieve.nearest_in_block(3, pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())]))
    tracemalloc.start()
    got = run(held, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20  # all distances at once are 128 MB, several times over
    monkeypatch.setattr(retrieve, "CELL", 1 << 40)
    assert got.equals(run(held, rows))
