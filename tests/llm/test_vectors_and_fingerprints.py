"""Fingerprints, whitening and clustering on awkward rows, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from gristmill.llm import clusters, fingerprints, whitening

VECTORS = "vec_id long, embedding array<double>, label int, x int, cluster int, vector int, tree int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, 1, 2, 3, 4) for i, v in rows], VECTORS)


def texts(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, 2) for r in rows], "doc_id long, text string, h string, place int, at int")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Near copies, empty, null, short, repeated and long texts; repeated and null ids."""
    rng = random.Random(3)
    base = prose(rng, 400)
    out = [(1, None), (2, ""), (3, "a"), (4, "ab"), (5, "été 漢字 😀 " * 30), (6, base), (6, base), (6, prose(rng, 20)), (None, base), (None, None)]
    for i in range(12):
        x = list(base)
        for _ in range(3 * i):
            at, how = rng.randrange(len(x)), rng.randrange(3)
            x[at : at + (how != 1)] = "z" * (how != 2)
        out.append((20 + i, "".join(x)))
    out += [(40 + i, prose(rng, 60)) for i in range(20)] + [(70, prose(rng, 40_000))]
    return out


def plain_walk(text, w):
    """What the walk shows at each step, step by step."""
    c, stays = fingerprints.classes(text), fingerprints._stays()
    out = []
    for x in c:
        out += [int(x)] * int(stays[w, len(out) % fingerprints._PERIOD, x])
    return out


def plain_fingerprint(text):
    parts = []
    for w in range(fingerprints.WALKS):
        shown, level = plain_walk(text, w), 0
        while -(-len(shown) // (1 << level)) > fingerprints.SAMPLES:
            level += 1
        steps = [int(s) for s in fingerprints._places(level, 0)]
        letters = "".join(chr(fingerprints._LETTERS[fingerprints._shown()[shown[s]]]) for s in steps if s < len(shown))
        parts.append(f"{level}:{letters}")
    return ".".join(parts)


def test_fingerprints_equal_a_walk_step_by_step(rows):
    own = [t or "" for _, t in rows]
    assert fingerprints.written(*fingerprints.fingerprinted(own)) == [plain_fingerprint(t) for t in own]


def test_stays_are_those_of_shared_bits():
    stays = fingerprints._stays().astype(int)
    assert (stays[:, :-1][stays[:, :-1] > 1] == stays[:, 1:][stays[:, :-1] > 1] + 1).all()
    assert abs(stays.mean() - 2) < 0.02


def test_report(spark, rows):
    frame = texts(spark, rows).repartition(7)
    found = fingerprints.report(frame).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    own = {}
    for i, t in rows:
        own.setdefault(i, []).append(t or "")
    ids = sorted((i for i in own if i is not None), reverse=True) + [None]
    for at, i in enumerate(ids):
        after = own[ids[(at + 1) % len(ids)]]
        for r in by[i]:
            same = [t for t in own[i] if len(t) == r["n_chars"] and plain_fingerprint(t) == r["fingerprint"]]
            assert same
            cut = r["n_chars"] // 3
            edited = [same[0][: len(same[0]) - cut] + n[:cut] for n in after + own[i]]
            mine = [e for e in edited if hashlib.sha256(e.encode()).hexdigest() == r["edited_sha256"]]
            assert mine and r["edited_fingerprint"] == plain_fingerprint(mine[0])
            assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
            if r["n_chars"] > 300 and len(own[i]) == 1 and at + 1 < len(ids) and len(after) == 1 and 40 <= i:
                assert r["near_edited"] > 0.5 > r["near_next"]
    assert fingerprints.report(frame.where("false")).count() == 0
    alone = fingerprints.report(texts(spark, [(7, "abcdef")])).collect()[0]
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_likeness_of_levels(rows):
    a = fingerprints.fingerprinted(["", "abc", "abc" * 500, "abc" * 500])
    b = fingerprints.fingerprinted(["", "", "abc" * 500, "abc" * 520])
    near = fingerprints.likeness(a, b)
    assert near[0] == 1 and near[1] == 0 and near[2] == 1 and 0.9 < near[3] < 1
    assert (fingerprints.read(fingerprints.written(*a))[1] == a[1]).all()


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(8)
    for _ in range(150):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 25)))
        b = list(a) if rng.random() < 0.7 else [rng.choice("abé") for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 5)):
            at, how = rng.randint(0, len(b)), rng.randrange(3)
            b[at : at + (how != 1)] = ["c"] * (how != 2)
        b, most = "".join(b), rng.randint(0, 8)
        true = plain_distance(a, b)
        assert fingerprints.edit_distance(a, b, most) == (true if true <= most else None)


def test_near_copies(spark, rows):
    frame = texts(spark, rows)
    found = sorted(((r["doc_id"], r["component_id"]) for r in fingerprints.near_copies(frame, pivots=2, room=3).collect()), key=str)
    own = sorted({t or "" for _, t in rows})
    text, key = fingerprints.bands(*fingerprints.fingerprinted(own))
    banded = {}
    for t, k in zip(text.tolist(), key.tolist()):
        banded.setdefault(k, set()).add(t)
    parent = list(range(len(own)))

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for group in banded.values():
        for a in group:
            for b in group:
                if a < b and fingerprints.edit_distance(own[a], own[b], fingerprints.allowed(own[a], own[b], 64, 0.2)) is not None:
                    parent[top(a)] = top(b)
    at = {t: top(i) for i, t in enumerate(own)}
    least = {}
    for i, t in rows:
        if i is not None:
            least[at[t or ""]] = min(i, least.get(at[t or ""], i))
    assert found == sorted(((i, least.get(at[t or ""])) for i, t in rows), key=str)
    assert len({c for i, c in found if i is not None and 20 <= i <= 31}) == 1
    assert fingerprints.near_copies(frame.where("false")).count() == 0


def usable(rows, dim):
    return [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    out = [(i, rng.normal(0, 0.3, 6).round(3).tolist()) for i in range(300)]
    out += [(400 + i, [0.25, -0.5, 0.125, 0.0, 1.0, 0.5]) for i in range(150)] + [(7, out[7][1]), (None, out[9][1])]
    return out + [(900, None), (901, []), (902, [1.0] * 5), (903, [None] + [0.0] * 5), (904, [float("nan")] + [0.0] * 5), (905, [float("inf")] + [0.0] * 5)]


def plain_clusters(rows, k, rounds, salt=2):
    xs = [[int(np.floor(256 * x)) if abs(x) < 1e12 else int(x) * 256 for x in v] for _, v in rows]
    order = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v, x) for (i, v), x in zip(rows, xs) if i is not None)
    z = [x for *_, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(z))
    for _ in range(rounds):
        own = [near(x)[1] for x in xs]
        for c in set(own):
            part = [x for x, n in zip(xs, own) if n == c]
            z[c] = [sum(column) // len(part) for column in zip(*part)]
    found = [(i, *near(x)[::-1]) for (i, _), x in zip(rows, xs)]
    inertia = {c: sum(d for _, n, d in found if n == c) for c in range(len(z))}
    digest = lambda c: hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()
    end = (1 << 63) - 1
    return [(i, c, min(d, end), min(inertia[c], end), min(sum(inertia.values()), end), digest(c)) for i, c, d in found]


@pytest.mark.parametrize("k, scale", [(9, 1.0), (3, 1e30), (600, 1.0)])
def test_clusters(spark, points, k, scale):
    rows = [(i, v and [x and x * scale for x in v]) for i, v in points]
    found = clusters.report(vectors(spark, rows).repartition(3), k=k, rounds=3, dim=6, block=64, leaf=5)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_clusters(usable(rows, 6), k, 3), key=str)


def test_clusters_of_nothing(spark):
    assert clusters.report(vectors(spark, [(1, None), (None, [0.5] * 64)])).count() == 0
    assert clusters.report(vectors(spark, []).where("false")).count() == 0


def test_filtering_strikes_out_and_assigns_whole_nodes():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-5, 5, (400, 2)) + c for c in ((0, 0), (500, 0), (0, 500))])
    tree, z = clusters.Tree(points, 8), np.array([[0, 0], [500, 0], [0, 500], [500, 500], [250, 250]])
    visited = sum(len(nodes) for nodes, *_ in tree.filtered(z))
    assert visited < len(tree.first) / 4  # most nodes are never opened
    counts, sums = tree.totals(z)
    nearest = clusters.distances(points, z).argmin(1)
    assert counts.tolist() == np.bincount(nearest, minlength=5).tolist()
    assert (sums == np.stack([points[nearest == c].sum(0) for c in range(5)])).all()


def test_ties_go_to_the_smaller_number():
    tree = clusters.Tree(np.array([[0], [1], [2], [1], [1]]), 1)
    cluster, distance = tree.assigned(np.array([[2], [0], [2], [0]]))
    assert sorted(zip(tree.order.tolist(), cluster.tolist(), distance.tolist())) == [(0, 1, 0), (1, 0, 1), (2, 0, 0), (3, 0, 1), (4, 0, 1)]


def test_whitening(spark, points):
    found = whitening.whiten(vectors(spark, points).repartition(3)).collect()
    kept = usable(points, 6)
    x = np.floor(256 * np.array([v for _, v in kept])).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    covariance = (fit - s / n).T @ (fit - s / n) / n
    e, q = np.linalg.eigh(covariance)
    e, q = e[::-1], q[:, ::-1]
    assert len(found) == 4 * len(kept) and all(r["n"] == n and r["identity_error"] < 1e-9 for r in found)
    for c in range(4):
        want = (x - s / n) @ q[:, c] / np.sqrt(e[c])
        deviation = ((n * x - s) ** 2).sum(1).tolist()
        own = [r for r in found if r["component"] == c + 1]
        assert all(abs(r["explained"] - e[c] / np.trace(covariance)) < 1e-12 for r in own)
        sides = []
        for sign in (1, -1):
            near = lambda rows: sorted(((i is None, i or 0, d, round(w, 7) + 0.0) for i, d, w in rows))
            sides.append(near((r["vec_id"], r["deviation"], r["whitened"]) for r in own) == near((i, d, sign * w) for (i, _), d, w in zip(kept, deviation, want)))
        assert any(sides)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, []).where("false")).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None)])).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [i / 2, float(i)]) for i in range(9)] + [(20, [1.0])])).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12 and {r["vec_id"] for r in line} == set(range(9))
    huge = whitening.whiten(vectors(spark, [(i, [1e12 * i, float(i % 2)]) for i in range(5)])).collect()
    assert {r["vec_id"] for r in huge} == set(range(5)) and all(r["deviation"] is None for r in huge if r["vec_id"] != 2)
