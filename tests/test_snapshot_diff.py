import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opslens.functions.paths import plain_path
from opslens.operators.snapshot_diff import snapshot_changes

SCHEMA = "id long, snapshot_no int, kind string, path string, sha256 string, mtime double, loaded_at timestamp_ntz, chunk string, n int"
T0 = datetime(2026, 1, 5)


def plain(path):
    out = []
    for p in path.replace("\\", "/").split("/"):
        if p == "..":
            out = out[:-1]
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def brute(rows):
    last = {}
    for _, s, _, p, sha, mt, at, _, _ in rows:
        if s is None or p is None:
            continue
        k, v = (s, plain(p)), (at or datetime.min, (sha or "").strip().lower() or None, None if mt is None else int(mt // 1))
        if k not in last or (v[0], v[1] or "", v[2] if v[2] is not None else -1) > (last[k][0], last[k][1] or "", last[k][2] if last[k][2] is not None else -1):
            last[k] = v
    numbers, out = {s for s, _ in last}, set()
    for s in numbers:
        if s - 1 not in numbers:
            continue
        new = {p: v[1:] for (n, p), v in last.items() if n == s}
        old = {p: v[1:] for (n, p), v in last.items() if n == s - 1}
        out |= {(s, p, "added") for p in new.keys() - old.keys()} | {(s, p, "removed") for p in old.keys() - new.keys()}
        for p in new.keys() & old.keys():
            (a, x), (b, y) = new[p], old[p]
            if (a != b) if a and b else (x != y):
                out.add((s, p, "changed"))
    return out


def test_plain_path(spark):
    cases = ["a/b", "./a/b", "a//b", "a\\b", "a/x/../b", "/a/b/", "../a", ".\\a\\.\\b", "a/../../b", "..a/b..", "", None]
    got = spark.createDataFrame([(c,) for c in cases], "p string").select(plain_path(F.col("p")).alias("q")).collect()
    assert [r.q for r in got] == [None if c is None else plain(c) for c in cases]


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    state = {f"d{i % 7}/f{i}.sh": (f"{i:04x}", 100.25 + i) for i in range(600)}
    for s in (1, 2, 3, 5):
        for p in list(state):
            x = rng.random()
            if x < 0.02:
                del state[p]
            elif x < 0.05:
                state[p] = (f"{rng.random():.9f}", 900.5 + rng.randrange(9))
        state |= {f"new/{s}_{i}.sh": ("ab", 1.0) for i in range(9)}
        for p, (sha, mt) in state.items():
            spelled = rng.choice([p, p, p, "./" + p, p.replace("/", "\\"), p.replace("/", "//")])
            x = rng.random()
            sha = None if x < 0.1 else sha.upper() if x < 0.2 else sha
            rows.append((len(rows), s, "k", spelled, sha, float(int(mt)) if x > 0.8 else mt, T0 + timedelta(days=s), "c", 1))
            if x > 0.95:
                rows.append((len(rows), s, "k", p, "old", 5.0, T0 + timedelta(days=s, hours=-1), "c", 1))
    rows += [(0, None, "k", "x", "a", 1.0, T0, "c", 1), (0, 1, "k", None, "a", 1.0, T0, "c", 1), (0, 1, "k", "nul", None, None, T0, "c", 1), (0, 2, "k", "nul", None, None, None, "c", 1)]
    got = [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_empty(spark):
    got = snapshot_changes(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["snapshot_no", "path", "change"] and got.count() == 0
