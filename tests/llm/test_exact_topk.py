import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import exact_topk as tk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5, every=50):
    fine = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in fine:
        if i % every == 0:
            scored = []
            for j, w in fine:
                n = min(len(v), len(w))
                if j != i:
                    scored.append((-int(v[:n] @ w[:n]), j))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_sql_says_the_same(spark, sample):
    df = spark.read.parquet(f"{sample}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sample}/embeddings.parquet'")
    want = sorted(con.execute(tk.ORACLE_SQL).fetchall())
    assert got(tk.top_k(df, F.col("vec_id") % 50 == 0)) == want
    assert got(tk.top_k(df, F.col("vec_id") % 50 == 0, block=70, query_block=4)) == want


def test_clustered_vectors_are_pruned_exactly(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 5
    rows = [(i, (centres[i % 20] + rng.normal(size=8) * 0.05).round(3).tolist()) for i in range(3000)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert got(tk.top_k(df, F.col("vec_id") % 50 == 0)) == brute(rows)


def test_edge_rows(spark):
    same = [0.5, -0.25]
    rows = [(0, same), (1, same), (2, same), (3, same), (4, same), (5, same), (6, None), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (50, [-0.001, 0.003]), (100, [1e7, -1e7]), (None, same), (150, []), (11, [0.1, 0.2, 9.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 as v", "2 as rank", "3 as qb")
    assert got(tk.top_k(df, F.col("vec_id") % 50 == 0)) == brute(rows)
    few = [(0, [1.0]), (50, [2.0])]
    assert got(tk.top_k(spark.createDataFrame([(i, v, 0) for i, v in few], SCHEMA), F.col("vec_id") % 50 == 0)) == brute(few)
    assert tk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_the_tree_covers_nests_and_separates():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(60, 4)) * 0.1 + c for c in rng.normal(size=(40, 4)) * 9])

    def walk(node):
        away = np.sqrt(((points[node.rows] - node.centre) ** 2).sum(1))
        assert np.isclose(away.max(), node.radius)
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            assert any((c.centre == node.centre).all() for c in node.children)
            centres = np.array([c.centre for c in node.children])
            gaps = np.sqrt(((centres[:, None] - centres) ** 2).sum(2))[~np.eye(len(centres), dtype=bool)]
            assert gaps.min() > node.radius / 2 and all(c.radius <= node.radius / 2 for c in node.children)
        return 1 + sum(map(walk, node.children))

    root = tk.cover_tree(points)
    assert walk(root) > 40 and 1 < len(tk.leaves(tk.cover_tree(points, most=16))) <= 16


def clusters(n, seed=4, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim)) * 5
    return [(i, (centres[i * 7 % 20] + rng.normal(size=dim) * 0.05).round(3).tolist()) for i in range(n)]


def test_groups_are_pruned_before_the_shuffle(spark, monkeypatch):
    met = []
    monkeypatch.setattr(tk, "_meet", lambda *a, f=tk._meet, **b: met.append(a[2]) or f(*a, **b))
    rows = clusters(3000)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert got(tk.top_k(df, F.col("vec_id") % 50 == 0, block=100, query_block=30)) == brute(rows)
    groups = met[0].shape[0]
    assert groups >= 20 and sum(m.sum() for m in met) < 0.3 * groups**2


def test_node_pairs_are_pruned_inside_a_task():
    rows = np.array([np.floor(256 * np.array(v)) for _, v in clusters(4000)]).astype(np.int64)
    s = tk.Search(rows[::50], np.arange(0, 4000, 50), rows, np.arange(4000), 5)
    s.run()
    assert s.scored < 0.5 * 80 * 4000


def test_huge_components(spark):
    rows = [(0, [1e12, 1e12]), (1, [1e12, 1.0]), (2, [1e12, 2.0]), (3, [-1e12, -1e12]), (4, [3e5, 1.0]), (5, [3e5, 1.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    out = got(tk.top_k(df, F.col("vec_id") % 50 == 0))
    high, low = 2**63 - 1, -(2**63)
    assert out == [(0, 1, 1, high), (0, 2, 2, high), (0, 3, 4, high), (0, 4, 5, high), (0, 5, 3, low)]
    near = [(0, [2.0**20, 3.0]), (1, [2.0**20, 1.0]), (2, [2.0**20, 1.25]), (3, [-(2.0**20), 7.0])]  # sums beyond 2^53, within 64 bits
    df = spark.createDataFrame([(i, v, 0) for i, v in near], SCHEMA)
    assert got(tk.top_k(df, F.col("vec_id") % 50 == 0)) == brute(near)


def share(n_clusters, n, dim, every):
    """Scored pairs over all pairs, one row in `every` asking, in one task; the result is held against all pairs."""
    rng = np.random.default_rng(n_clusters)
    centres = rng.normal(size=(n_clusters, dim)) * 5
    points = np.floor(256 * (centres[rng.integers(0, n_clusters, n)] + rng.normal(size=(n, dim)) * 0.05)).astype(np.int64)
    queries = np.arange(0, n, every)
    s = tk.Search(points[queries], queries, points, np.arange(n), 5)
    s.run()
    scores = points[queries].astype(float) @ points.T.astype(float)
    scores[np.arange(len(queries)), queries] = -np.inf
    for k, best in enumerate(s.best):
        assert [-x for x, _ in best] == np.sort(scores[k])[::-1][:5].tolist()
    return s.scored / (len(queries) * n)


def test_few_queries_are_pruned_by_their_own_scores():
    assert share(20, 8000, 64, 50) < 0.2
    assert share(200, 8000, 64, 50) < 0.2
    assert share(20, 8000, 4, 50) < 0.2


def test_repeated_ids_agree_with_sql(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).round(3).tolist()) for i in range(120)]
    rows += [rows[50], rows[50], rows[7], (50, [0.5, 0.5, 0.5, 0.5]), (100, [1.0, -1.0, 0.25, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", [list(r) for r in rows])
    want = sorted(con.execute(tk.ORACLE_SQL).fetchall())
    assert got(tk.top_k(df, F.col("vec_id") % 50 == 0)) == want
    assert got(tk.top_k(df, F.col("vec_id") % 50 == 0, block=20, query_block=2)) == want
