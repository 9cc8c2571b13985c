"""Places of keywords and of dendrogram links against loops."""

import hashlib
import math
import random

import pytest

from parley.operators import layout


def plain_layout(names, weights, force, rounds):
    names = sorted(names)
    n = len(names)
    at = [[int(hashlib.md5(x.encode()).hexdigest()[8 * a : 8 * a + 8], 16) / 2**32 for a in (0, 1)] for x in names]
    heat = 0.1 * max(max(p[a] for p in at) - min(p[a] for p in at) for a in (0, 1))
    t = heat
    for _ in range(rounds):
        new = []
        for i in range(n):
            x = y = 0.0
            for j in range(n):
                dx, dy = at[i][0] - at[j][0], at[i][1] - at[j][1]
                d = max(math.hypot(dx, dy), 0.01)
                f = force**2 / d**2 - weights.get((names[i], names[j]), weights.get((names[j], names[i]), 0.0)) * d / force
                x, y = x + dx * f, y + dy * f
            size = max(math.hypot(x, y), 0.01)
            new.append([at[i][0] + x * t / size, at[i][1] + y * t / size])
        way = math.sqrt(sum((p[a] - q[a]) ** 2 for p, q in zip(at, new, strict=True) for a in (0, 1)))
        at = new
        t -= heat / (rounds + 1)
        if way / n < 1e-4:
            break
    mid = [sum(p[a] for p in at) / n for a in (0, 1)]
    at = [[p[a] - mid[a] for a in (0, 1)] for p in at]
    size = max(abs(c) for p in at for c in p) or 1.0
    return {x: (p[0] / size, p[1] / size) for x, p in zip(names, at, strict=True)}


@pytest.mark.parametrize(("n", "rounds"), [(12, 20), (7, 100), (1, 5), (2, 3)])
def test_layout_by_loops(spark, n, rounds):
    draw = random.Random(n)
    names = [f"w{i}" for i in range(n)]
    weights = {(a, b): draw.random() * 30 for a in names for b in names if a < b and draw.random() < 0.4}
    edges = spark.createDataFrame([(*k, w) for k, w in weights.items()], "k1 string, k2 string, weight double")
    got = layout.network_layout(spark.createDataFrame([(x,) for x in names], "term string"), edges, rounds=rounds).collect()
    want = plain_layout(names, weights, 1.5, rounds)
    assert len(got) == n and all(abs(r["x"] - want[r["term"]][0]) < 1e-6 and abs(r["y"] - want[r["term"]][1]) < 1e-6 for r in got)


def test_no_keywords(spark):
    none = spark.createDataFrame([], "term string")
    assert layout.network_layout(none, spark.createDataFrame([], "k1 string, k2 string, weight double")).count() == 0


def linkage(n, kind):
    """Merges of n leaves: a chain, a random tree, or one side only."""
    draw = random.Random(n)
    alive, size, out = list(range(n)), {i: 1 for i in range(n)}, []
    for step in range(n - 1):
        if kind == "chain":
            pair = [alive.pop(), alive.pop(0)] if step % 2 else [alive.pop(0), alive.pop()]
        else:
            pair = [alive.pop(draw.randrange(len(alive))) for _ in range(2)]
        size[n + step] = size[pair[0]] + size[pair[1]]
        out.append((step, *pair, float(step + 1), size[n + step]))
        alive.append(n + step)
    return out


@pytest.mark.parametrize(("n", "kind"), [(2, "random"), (3, "chain"), (40, "random"), (60, "chain")])
def test_links_by_recursion(spark, n, kind):
    merges = linkage(n, kind)
    parts = {n + s: (a, b, h) for s, a, b, h, _ in merges}
    order = []

    def visit(node):
        if node < n:
            order.append(node)
        else:
            visit(parts[node][0])
            visit(parts[node][1])

    visit(2 * n - 2)
    at = {leaf: 10.0 * i + 5 for i, leaf in enumerate(order)}
    high = dict.fromkeys(range(n), 0.0) | {k: v[2] for k, v in parts.items()}
    for node in sorted(parts):
        at[node] = (at[parts[node][0]] + at[parts[node][1]]) / 2
    table = spark.createDataFrame(merges, "step long, a long, b long, height double, size long")
    got = {r["step"]: tuple(r[1:]) for r in layout.dendrogram_links(table).collect()}
    assert set(got) == set(range(n - 1))
    for s, a, b, h, _ in merges:
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(got[s], (h, at[a], at[b], high[a], high[b]), strict=True))
    leaves = {r["node"]: r["before"] for r in layout.dendrogram_nodes(table).filter(f"node < {n}").collect()}
    assert [x for x, _ in sorted(leaves.items(), key=lambda x: x[1])] == order


def test_no_merges(spark):
    assert layout.dendrogram_links(spark.createDataFrame([], "step long, a long, b long, height double, size long")).count() == 0
