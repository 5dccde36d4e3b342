"""Point-in-time graph features: hand-computed cases and enumeration."""

from __future__ import annotations

import random

import pytest

from tidewatch.errors import ConvergenceError, DataQualityError
from tidewatch.operators import graph
from tidewatch.operators.communities import MovingConfig, communities, local_moving, modularity, undirected

NODES, EDGES = "id string, step int, label int", "src string, dst string"


def features(spark, nodes, edges, hub_degree=512):
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    nobody = spark.createDataFrame([], "id string, community long")
    rows = graph.graph_features(n, e, nobody, hub_degree).collect()
    return {r["id"]: r for r in rows}


def brute(nodes, edges):
    step, label = {n: s for n, s, _ in nodes}, {n: x for n, _, x in nodes}
    out = {}
    for v, t, _ in nodes:
        seen = {(a, b) for a, b in edges if max(step[a], step[b]) <= t}
        pred, succ = {a for a, b in seen if b == v}, {b for a, b in seen if a == v}
        both = sum((v, p) in seen for p in pred) + sum((s, v) in seen for s in succ)
        one = pred | succ
        two = {x for n in one for a, b in seen if n in (a, b) for x in (a, b) if x != n or a == b}
        two = (two - one) - {v}
        share = lambda s: sum(label[x] == 1 for x in s) / len(s) if s else 0.0
        earlier = [step[n] for n in one if step[n] < t]
        degree = len(pred) + len(succ)
        out[v] = (
            len(pred), len(succ), both / degree if degree else 0.0, share(one), share(one | two), -1,
            t - max(earlier) if earlier else 0,
        )
    return out


def test_ladder_by_hand(spark):
    """Rungs join two rails; every second step is illicit; one rung goes both ways."""
    nodes = [(f"{rail}{i}", i + 1, 1 if i % 2 else 2) for rail in "pq" for i in range(4)]
    edges = [(f"{rail}{i}", f"{rail}{i + 1}") for rail in "pq" for i in range(3)]
    edges += [(f"p{i}", f"q{i}") for i in range(4)] + [("q2", "p2")]
    got = features(spark, nodes, edges)
    # p2 knows p1 (illicit) and q2; behind them p0 and q1 (illicit)
    assert (got["p2"]["in_degree"], got["p2"]["out_degree"], got["p2"]["reciprocity"]) == (2, 1, 2 / 3)
    assert (got["p2"]["ego_illicit_1hop"], got["p2"]["ego_illicit_2hop"]) == (1 / 2, 2 / 4)
    assert got["q3"]["time_since_activity"] == 1 and got["p0"]["time_since_activity"] == 0
    want = brute(nodes, edges)
    assert all(tuple(r[c] for c in graph.FEATURES) == pytest.approx(want[k]) for k, r in got.items())


def test_fountain_sees_only_what_has_happened(spark):
    """A source pays ten others, two per step; each of them sees the earlier ones."""
    nodes = [("spring", 1, None)] + [(f"bowl{i}", 1 + i // 2, 1 if i in (0, 3, 8) else 2) for i in range(10)]
    nodes.append(("dry", 5, 1))
    got = features(spark, nodes, [("spring", f"bowl{i}") for i in range(10)])
    assert (got["spring"]["out_degree"], got["spring"]["ego_illicit_1hop"]) == (2, 1 / 2)
    # bowl9 at step 5: the spring and the nine other bowls, three of them illicit
    assert (got["bowl9"]["ego_illicit_1hop"], got["bowl9"]["ego_illicit_2hop"]) == (0.0, 3 / 10)
    assert got["bowl2"]["ego_illicit_2hop"] == 2 / 4 and got["bowl9"]["time_since_activity"] == 4
    assert got["dry"]["in_degree"] == got["dry"]["out_degree"] == got["dry"]["time_since_activity"] == 0


@pytest.mark.parametrize(("seed", "hub_degree"), [(1, 1), (1, 3), (2, 8), (2, 512)])
def test_same_as_enumeration_with_and_without_hubs(spark, seed, hub_degree):
    rng = random.Random(seed)
    nodes = [(f"n{i:02d}", rng.randrange(1, 6), rng.choice([1, 2, None])) for i in range(24)]
    ids = [n for n, _, _ in nodes]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(45)]
    edges += [("n00", rng.choice(ids)) for _ in range(20)] + edges[:5]  # a hub and parallel edges
    edges += [("n05", "n05")]
    got = {k: tuple(r[c] for c in graph.FEATURES) for k, r in features(spark, nodes, edges, hub_degree).items()}
    want = brute(nodes, edges)
    assert got.keys() == want.keys()
    for node in want:
        assert got[node] == pytest.approx(want[node]), node


def test_lookahead_edges_are_refused(spark):
    edges = spark.createDataFrame([("a", "b", 34, 35, 35)], "src string, dst string, src_step int, dst_step int, visible_step int")
    with pytest.raises(DataQualityError, match="look-ahead"):
        graph.check_no_lookahead_edges(edges, 34)
    assert graph.inductive_edges(edges, 34).isEmpty()


def test_dangling_ends(spark):
    nodes = spark.createDataFrame([("a", 1, 1)], NODES)
    ends = graph.dangling_ends(nodes, spark.createDataFrame([("a", "z")], EDGES))
    assert [r["id"] for r in ends.collect()] == ["z"]


def test_two_triangles_are_two_communities(spark):
    edges = spark.createDataFrame(
        [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1"), ("a1", "b1")], EDGES
    )
    first = {r["id"]: r["community"] for r in communities(edges).collect()}
    assert first == {"a1": "a1", "a2": "a1", "a3": "a1", "b1": "b1", "b2": "b1", "b3": "b1"}
    assert first == {r["id"]: r["community"] for r in communities(edges.repartition(3)).collect()}


def sequential_levels(pairs):
    """Plain local moving, node by node, and coarsening; the modularity reached."""
    graph = {}
    for a, b in {tuple(sorted(p)) for p in pairs}:
        for u, v in ((a, b), (b, a)):
            graph.setdefault(u, {})[v] = 1
    two_m = sum(sum(near.values()) for near in graph.values())
    reached = -1.0
    while True:
        k = {u: sum(near.values()) for u, near in graph.items()}
        home, total = {u: u for u in graph}, dict(k)
        moved = True
        while moved:
            moved = False
            for u in graph:
                links = {}
                for v, w in graph[u].items():
                    if v != u:
                        links[home[v]] = links.get(home[v], 0) + w
                total[home[u]] -= k[u]
                gain = {c: w - k[u] * total[c] / two_m for c, w in links.items()}
                stay = gain.get(home[u], -k[u] * total[home[u]] / two_m)
                best = max(gain, key=gain.get, default=home[u])
                if gain.get(best, stay) > stay + 1e-9:
                    home[u], moved = best, True
                total[home[u]] += k[u]
        inside, coarse = 0.0, {}
        for u, near in graph.items():
            for v, w in near.items():
                coarse.setdefault(home[u], {})[home[v]] = coarse.setdefault(home[u], {}).get(home[v], 0) + w
                inside += w if home[u] == home[v] else 0
        quality = inside / two_m - sum((t / two_m) ** 2 for t in total.values())
        if quality <= reached + 1e-7:
            return reached
        reached, graph = quality, coarse


def chain_with_shortcuts(n):
    rng = random.Random(8)
    return [(i, i + 1) for i in range(n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 8)]


def test_communities_match_a_sequential_search(spark):
    pairs = [(a, b) for a, b in chain_with_shortcuts(600) if a != b]
    frame = spark.createDataFrame(pairs, "src long, dst long")
    found = communities(frame)
    got = modularity(undirected(frame), found).first()[0]
    assert got > 0.99 * sequential_levels(pairs)


def test_no_node_wants_to_move_at_the_end_of_a_level(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted((rng.randrange(120), rng.randrange(120)))) for _ in range(500)}
    pairs |= {(0, i) for i in range(1, 60)}  # a hub
    pairs = {p for p in pairs if p[0] != p[1]}
    graph = undirected(spark.createDataFrame(sorted(pairs), "src long, dst long"))
    state, quality = local_moving(graph, MovingConfig())
    home = {r["id"]: r["community"] for r in state.collect()}
    near = {u: [b if a == u else a for a, b in pairs if u in (a, b)] for u in home}
    total, two_m = {}, 2 * len(pairs)
    for u, c in home.items():
        total[c] = total.get(c, 0) + len(near[u])
    for u, c in home.items():
        def gain(d, u=u, c=c):
            links = sum(home[v] == d for v in near[u])
            return links - len(near[u]) * (total[d] - (len(near[u]) if d == c else 0)) / two_m
        assert max(gain(home[v]) for v in near[u]) <= gain(c) + 1e-6
    assert abs(modularity(graph, state).first()[0] - quality) < 1e-9


def test_a_search_that_does_not_end_raises(spark):
    frame = spark.createDataFrame(chain_with_shortcuts(60), "src long, dst long").filter("src <> dst")
    with pytest.raises(ConvergenceError):
        communities(frame, MovingConfig(limit=2))


def test_communities_beat_singletons_and_the_whole(spark):
    rng = random.Random(3)
    edges = []
    for block in range(4):
        members = [block * 10 + i for i in range(10)]
        edges += [(rng.choice(members), rng.choice(members)) for _ in range(30)]
    edges += [(1, 11), (21, 31), (12, 33)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    found = communities(frame)
    q = modularity(undirected(frame), found).first()[0]
    whole = found.selectExpr("id", "0L AS community")
    assert q > 0.55 and q > modularity(undirected(frame), whole).first()[0]


def test_neighbour_means(spark):
    feats = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 9.0)], "id string, f double")
    edges = spark.createDataFrame([("a", "c"), ("b", "c")], EDGES)
    means = {r["id"]: r["f_n"] for r in graph.neighbour_means(edges, feats, ["f"], "_n").collect()}
    assert means == {"a": 0.0, "b": 0.0, "c": 2.0}
