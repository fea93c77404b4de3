import math

import numpy as np

from veritide.llm import embeddings, queries

SF = "/root/testdata/sf0.1"


def plain(rows, floor=0.95):
    """(n_links, component) of each row, by comparing all of them."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = [set() for _ in rows]
    for dim in {len(v) for (_, v), k in zip(rows, ok, strict=True) if k}:
        at = [i for i, (_, v) in enumerate(rows) if ok[i] and len(v) == dim]
        x = np.array([rows[i][1] for i in at], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for p, line in enumerate(x @ x.T >= floor):
            near[at[p]] = {at[q] for q in np.flatnonzero(line) if q != p}
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[i] = (len(near[i]), min(ids) if ids else None)
    return out


def test_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = plain(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op8_embedding_ego(spark, SF).collect()}
    assert got == {rows[i][0]: w for i, w in want.items()}


def test_edge_rows_and_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 6))
    v = [c + rng.normal(size=6) * 0.15 for c in centres for _ in range(8)]
    rows = [(k, [float(x) for x in a]) for k, a in enumerate(v)]
    rows += [(300 + k, rows[5][1]) for k in range(20)] + [(400, [2 * x for x in rows[5][1]])]
    rows += [(500, None), (501, []), (502, [0.0] * 6), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (504, [float("nan")] * 6), (505, [float("inf")] * 6)]
    rows += [(None, rows[9][1]), (5, rows[5][1]), (600, [1.0, 0.0]), (601, [1.0, 0.1]), (None, None), (602, [1e200, 1e200]), (603, [1e-200, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "ID")
    want = sorted(((rows[i][0] is None, rows[i][0] or 0), n, -1 if c is None else c) for i, (n, c) in plain([(i, v and [x / max(map(abs, v)) for x in v] if v and all(x is not None and math.isfinite(x) for x in v) and any(v) else v) for i, v in rows]).items())
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    got = sorted(((r.id is None, r.id or 0), r.n_links, -1 if r.component is None else r.component) for r in embeddings.embedding_groups(df, "ID").collect())
    assert got == want
    assert embeddings.embedding_groups(df.limit(0), "ID").count() == 0


def test_intervals_find_all_pairs():
    rng = np.random.default_rng(0)
    x = embeddings.unit_rows(np.repeat(rng.normal(size=(60, 8)), 10, axis=0) + rng.normal(size=(600, 8)) * 0.2)
    i, j = map(np.concatenate, zip(*embeddings.join_intervals(x, x, x, x, 0.95, True), strict=True))
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if a < b}
    assert set(zip(i, j, strict=True)) == want and len(i) == len(want)


def test_a_dense_cluster_keeps_no_pairs():
    import tracemalloc

    rng = np.random.default_rng(1)
    x = embeddings.unit_rows(np.ones((3000, 16)) + rng.normal(size=(3000, 16)) * 0.05)
    assert (x[:50] @ x.T).min() > 0.95  # 4.5 million pairs, all linked
    tracemalloc.start()
    links, label = embeddings.folded([x], [np.ones(3000, np.int64)], [x], 0.95)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == 2999).all() and (label == 0).all() and most < 40e6
    a, b = embeddings.folded([x[:1000], x[1000:]], [np.full(1000, 2), np.ones(2000, np.int64)], [x[:1000], x[1000:]], 0.95)
    assert (a[:1000] == 2000).all() and (a[1000:] == 2000).all() and (b == 0).all()
