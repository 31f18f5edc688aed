import numpy as np
import pytest

from boskage.operators import cluster, graph


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def two_cliques():
    rows = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)]
    return [*rows, (0, 10, 0.1), (50, 51, 1.0)]


def brute_components(rows, extra=()):
    label = {v: v for r in rows for v in r[:2]} | {v: v for v in extra}
    for _ in range(len(label)):
        for a, b, *_ in rows:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 150, (110, 2)) if a != b] + [(k, k + 1, 1.0) for k in range(200, 260)] + [(7, 7, 1.0)]
    df = edges(spark, rows)
    got = {r.uid: r.component for r in graph.components(df, spark.range(300).withColumnRenamed("id", "uid")).collect()}
    assert got == brute_components(rows, range(300))
    assert graph.components(df.limit(0)).count() == 0


def test_build_drops_loops_nulls_and_repeats(spark):
    df = spark.createDataFrame([(2, 1, 0.5), (1, 2, 0.9), (3, 3, 1.0), (None, 1, 1.0), (4, 5, None)], "src long, dst long, weight double")
    assert sorted(map(tuple, graph.build(df).collect())) == [(1, 2, 0.9), (4, 5, None)]


@pytest.mark.parametrize("most", [200_000, 5])
def test_louvain_finds_cliques(spark, most):
    df = edges(spark, two_cliques())
    got = {r.uid: r.community for r in graph.louvain(df, spark.range(60).withColumnRenamed("id", "uid"), most_edges=most).collect()}
    assert len(got) == 60
    assert {got[k] for k in range(6)} == {0} and {got[k] for k in range(10, 16)} == {10}
    assert got[50] == got[51] == 50 and got[30] == 30
    member = spark.createDataFrame(list(got.items()), "uid long, community long")
    q = graph.modularity(df, member).first()[0]
    one = graph.modularity(df, member.selectExpr("uid", "0 as community")).first()[0]
    assert abs(one) < 1e-9 and q > 0.4


def test_louvain_levels_agree_with_the_kernel(spark):
    rng = np.random.default_rng(4)
    block = np.repeat(np.arange(6), 12)
    rows = [(a, b, 1.0) for a in range(72) for b in range(a + 1, 72) if rng.random() < (0.6 if block[a] == block[b] else 0.02)]
    df = edges(spark, rows)
    scores = [graph.modularity(df, graph.louvain(df, most_edges=m)).first()[0] for m in (200_000, 40)]
    assert min(scores) > 0.5 and abs(scores[0] - scores[1]) < 0.05


def test_hdbscan_and_dbscan():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(25, 1, (40, 2)), rng.uniform(-200, 200, (8, 2))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    labels, strength = cluster.hdbscan(d, 6, 2)
    assert len(set(labels[:40]) - {-1}) == 1 and len(set(labels[40:80]) - {-1}) == 1 and labels[0] != labels[41]
    assert (labels[80:] == -1).all() and ((strength >= 0) & (strength <= 1)).all() and (strength[labels == -1] == 0).all()
    assert (cluster.hdbscan(d[:4, :4], 6, 2)[0] == -1).all()
    same = cluster.hdbscan(np.zeros((7, 7)), 3, 2)[0]
    assert len(same) == 7
    assert cluster.dbscan(np.array([[0, 1, 9], [1, 0, 9], [9, 9, 0.0]]), 1, 2).tolist() == [0, 0, -1]


def test_spanning_tree_weight_is_least():
    rng = np.random.default_rng(1)
    d = rng.random((7, 7))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    done, total = {0}, 0.0
    while len(done) < 7:
        w, v = min((d[a, b], b) for a in done for b in range(7) if b not in done)
        total += w
        done.add(v)
    assert abs(cluster.spanning_tree(d)[:, 2].sum() - total) < 1e-12


def test_cluster_similarities(spark):
    members = spark.createDataFrame([(1, k) for k in range(5)] + [(2, 9)], "community long, uid long")
    pairs = spark.createDataFrame([(1, 0, 1, 0.9), (1, 1, 2, 0.8), (1, 3, 4, 0.1)], "community long, i long, j long, s double")
    got = {(r.community, r.uid): r.label for r in cluster.cluster_similarities(pairs, members, "dbscan", eps=0.3).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): -1, (1, 4): -1, (2, 9): 0}
    flat = {r.uid: r.label for r in cluster.dbscan_pairs(pairs, members, 0.3).collect()}
    assert flat == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1, 9: -1}
    for method in ("hdbscan", "spectral", lambda s: np.zeros(len(s), int)):
        assert cluster.cluster_similarities(pairs, members, method).count() == 6
    found = cluster.offset_labels(spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 2, 0), (4, 2, -1), (5, 7, 0)], "uid long, community long, label long"))
    assert {r.uid: r.label for r in found.collect()} == {1: 0, 2: 1, 3: 2, 4: -1, 5: 3}


def test_dbscan_of_large_communities(spark):
    n = cluster.MOST_MEMBERS + 5
    members = spark.range(n).selectExpr("1L community", "id uid")
    pairs = spark.range(0, n - 1, 2).selectExpr("1L community", "id i", "id + 1 j", "0.9D s").where("i < 20000")
    got = cluster.cluster_similarities(pairs, members, "dbscan", eps=0.3)
    assert got.count() == n and got.where("label = -1").count() == 5
    assert got.where("label >= 0 and label != uid div 2").count() == 0


def test_dbscan_and_hdbscan_over_pairs_meet_the_matrix(spark):
    rng = np.random.default_rng(3)
    rows = sorted({(c, int(min(a, b)), int(max(a, b))) for c in (1, 2) for a, b in rng.integers(0, 30, (40, 2)) if a != b})
    rows = [(c, i, j, float(rng.random())) for c, i, j in rows] + [(1, 2, 900, 1.0), (1, 3, 15_000, 1.0)]  # ends that are no members
    members = spark.createDataFrame([(c, k) for c in (1, 2) for k in range(30)], "community long, uid long")
    pairs = spark.createDataFrame(rows, "community long, i long, j long, s double")
    d = {c: np.ones((30, 30)) for c in (1, 2)}
    for c, i, j, s in rows:
        if j < 30:
            d[c][i, j] = d[c][j, i] = 1 - s
    for c in d:
        np.fill_diagonal(d[c], 0)
    solve = {"dbscan": lambda m, k: cluster.dbscan(m, 0.7, k), "hdbscan": lambda m, k: cluster.hdbscan(m, 2, k, count_self=True)[0]}
    for method in solve:
        for k in (2, 3):
            got = {(r.community, r.uid): r.label for r in cluster.cluster_similarities(pairs, members, method, min_samples=k).collect()}
            for c in d:
                assert [got[c, v] for v in range(30)] == solve[method](d[c], k).tolist(), (method, k, c)


def test_events_of_a_large_community(spark, monkeypatch):
    rows = [(k, 1, 1e5 * (k % 3) + k, 0.0, 0, "Fire") for k in range(120)]
    df = spark.createDataFrame(rows, "uid long, community long, cx double, cy double, mid_us long, class string")
    monkeypatch.setattr(cluster, "MOST_MEMBERS", 100)
    got = {r.uid: r.label for r in cluster.cluster_events(df).collect()}
    assert all(got[k] == got[k % 3] >= 0 for k in got) and len(set(got.values())) == 3
