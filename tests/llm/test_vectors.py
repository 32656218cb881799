"""Hard negatives, vector codes and license scans against brute force, and their odd cases."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import hard_negatives, licenses, vector_codes, vectors

from .conftest import ODD

KIND = "vec_id long, embedding array<float>, label int, q string, code string, own int, score long, rank int, block int"
NAN, INF = float("nan"), float("inf")


@pytest.fixture
def table(spark, tmp_path):
    """Rows (vec_id, vector, label) as the table embeddings of a folder, with columns of clashing names."""

    def make(rows):
        folder = tmp_path / str(random.random())
        spark.createDataFrame([(i, v, y, "x", "y", 1, 2, 3, 4) for i, v, y in rows], KIND).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
        return str(folder)

    return make


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def mined(rows):
    kept = [(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, q) for i, v, y in rows if (q := whole(v)) is not None and y is not None]
    anchors = {}
    for i, y, q in kept:
        if i is not None and i % 100 == 0:
            anchors[i] = min(anchors.get(i, (y, q)), (y, q))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (y, q) in anchors.items():
        own = sorted(((dot(q, p), j) for j, z, p in kept if j != i and z == y), key=order)[:5]
        for s, j in own:
            far = sorted(((dot(q, p), k) for k, z, p in kept if k != i and z != y and 80 * s <= 100 * dot(q, p) <= 100 * s), key=order)[:5]
            out += [(i, j, n, k, s, t) for n, (t, k) in enumerate(far, 1)]
    return out


ODD_ROWS = [
    (100, None, 1), (107, [0.5] * 16, None), (None, [0.4] * 16, 1), (None, [0.3] * 16, 2), (3, [0.1, None] + [0.2] * 14, 1), (4, [NAN] * 16, 1), (5, [INF] + [0.0] * 15, 2),
    (200, [0.5] * 16, 1), (201, [0.5] * 16, 1), (201, [0.5] * 16, 1), (202, [0.5] * 16, 2), (203, [0.45] * 16, 2), (200, [0.5] * 16, 2), (300, [], 3), (301, [0.1], 3), (302, [0.2] * 20, 4),
    (-100, [-0.5] * 16, 1), (-101, [-0.5] * 16, 1), (-102, [-0.45] * 16, -3), (400, [0.0] * 16, 9), (401, [0.0] * 16, 9), (402, [0.0] * 16, 8),
]


def many(n, seed=0, wide=16):
    r = np.random.default_rng(seed)
    axes = r.normal(size=(4, wide))
    x = r.normal(size=(n, 4)) @ axes + 0.4 * r.normal(size=(n, wide))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[n // 2 : n // 2 + n // 4] = x[0]  # a large group of copies
    return [(i, [float(np.float32(c)) for c in v], int(r.integers(0, 3))) for i, v in enumerate(x)]


@pytest.mark.parametrize("rows", [ODD_ROWS, many(700), ODD_ROWS + many(200, 1)[10:], [(0, [1.0, 2.0], 1)], [(100 * k, [0.25 * k, -0.5], 1 + k % 2) for k in range(30)]])
def test_hard_negatives_are_brute_force(spark, table, monkeypatch, rows):
    monkeypatch.setattr(hard_negatives, "TILE", 16)
    monkeypatch.setattr(hard_negatives, "PAIRS", 100)
    got = [tuple(r) for r in hard_negatives.op11_hard_negatives(spark, table(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, mined(rows)))


def test_hard_negatives_in_many_blocks(spark, table, monkeypatch):
    rows = [(i * 50, v, y) for i, v, y in many(300, 3)]
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 4096)
    got = [tuple(r) for r in hard_negatives.op11_hard_negatives(spark, table(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, mined(rows))) and got


def test_hard_negatives_beyond_longs(spark, table):
    """Scores beyond a long are the nearest long."""
    rows = [(100, [3e30, 1.0], 1), (1, [2e30, 1.0], 1), (2, [1e30, 5.0], 2), (3, [-1e30, 5.0], 2)]
    assert [tuple(r) for r in hard_negatives.op11_hard_negatives(spark, table(rows)).collect()] == [(100, 1, 1, 2, vectors.LONG, vectors.LONG)]


def test_embeddings_that_are_empty(spark, table):
    folder = table([(1, None, 1)])
    for f, n in ((hard_negatives.op11_hard_negatives, 6), (vector_codes.op12_vector_codes, 5)):
        out = f(spark, folder)
        assert out.collect() == [] and len(out.columns) == n


def test_pruning_discards_most_pairs_and_loses_none(spark):
    """Of strongly correlated vectors, few pairs survive the leading components."""
    rows = [(i, y, np.array(whole(v))) for i, v, y in many(2000, 5)]
    q = np.stack([x for _, _, x in rows])
    df = spark.createDataFrame([(i, y, x.tolist()) for i, y, x in rows], "vec_id long, label long, q array<long>")
    rotation = hard_negatives.Rotation(df)
    exact = q @ q.T
    assert np.allclose(hard_negatives.moments(df, 16), q.T @ q)
    low = np.sort(exact, 1)[:, -20].astype(float)
    block = hard_negatives.Block(rotation, np.arange(2000), np.zeros(2000), q, True, np.zeros((2000, 1)), np.zeros((2000, 1)))
    i, j = block.may(np.arange(2000), np.ones((2000, 2000), bool), block.y, block.norms, low, np.full(2000, np.inf))
    found = set(zip(i.tolist(), j.tolist()))
    assert {(a, b) for a, b in zip(*np.nonzero(exact >= low[:, None]))} <= found and len(found) < 0.4 * 2000**2


def lloyd(rows):
    """vec_id, code, error, label_error, digest by plain loops."""
    kept = [(i, y, q) for i, v, y in rows if (q := whole(v)) is not None]
    wide = -(-max(len(q) for _, _, q in kept) // 16) * 16
    kept = [(i, y, [*q, *[0] * (wide - len(q))]) for i, y, q in kept]
    low = lambda x: (x is None, x or 0)
    w, start = wide // 16, sorted(kept, key=lambda x: (low(x[0]), low(x[1]), x[2]))[:64]
    cut = lambda q, p: q[p * w : (p + 1) * w]
    books = [[cut(q, p) for _, _, q in start] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, p: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        groups = defaultdict(list)
        for _, _, q in kept:
            for p in range(16):
                groups[p, near(cut(q, p), p)[1]].append(cut(q, p))
        for (p, k), own in groups.items():
            books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = [(i, y, *zip(*(near(cut(q, p), p) for p in range(16)))) for i, y, q in kept]
    total = defaultdict(int)
    for _, y, d, _ in out:
        total[y] += sum(d)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in code), sum(d), total[y], digest) for i, y, d, code in out]


@pytest.mark.parametrize("rows", [ODD_ROWS, many(300, 2, 32), many(40, 4), [(1, [0.5], 1)], [(i, [0.25 * (i % 9)] * 16, 1) for i in range(100)], [(i, [(i * 7 % 13) * 1e12, 2.0] * 8, i % 3) for i in range(90)]])
def test_codes_are_lloyds(spark, table, rows):
    got = [tuple(r) for r in vector_codes.op12_vector_codes(spark, table(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, lloyd(rows)))


def test_bounds_save_scans(spark):
    rows = spark.createDataFrame([(i, y, whole(v)) for i, v, y in many(3000, 6)], "vec_id long, label long, q array<long>")
    state, books = vector_codes.fit(rows)
    scans = state.agg(F.avg("scans")).head()[0]
    assert 16 <= scans < 16 * 2.2  # three rounds without bounds: 48


def license_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def scanned(t, templates, threshold=0.9):
    w, places, blocks = license_words(t), [], []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(label, i) for i in range(len(w)) if w[i : i + len(p)] == p]
    for label, text in templates:
        own = set(license_words(text))
        if label is None or not own:
            continue
        step = 1
        while step < len(license_words(text)):
            step *= 2
        for b in range(0, max(1, len(w) - step), step):
            shared = len(own & set(w[b : b + 2 * step]))
            if shared >= max(1, math.ceil(threshold * len(own) - 1e-9)):
                blocks.append((label, b, min(len(w), b + 2 * step), shared, len(own)))
    return len(w), sorted(places), sorted(blocks)


PLANTED = [
    (100, "Released under the MIT License. " * 40), (101, "x " * 5000 + "licensed under the APACHE license, version 2.0" + " y" * 3000), (102, "gnu general public licence"),
    (103, "cc by cc by-nc 4.0 licensed under"), (104, "under license the released mit " + "a " * 14), (105, "mit" + " filler" * 20 + " license"), (106, "Été MIT\x00License\x7fmit_license"),
    (107, " ".join(licenses.TEMPLATES[6][1].split()[::-1]) if len(licenses.TEMPLATES) > 6 else ""), (108, licenses.TEMPLATES[8][1].replace("Software", "Software\n")), (109, "this work is licensed under the gnu general public license version 3"),
]


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_scan_is_brute_force(spark, docs_of, monkeypatch, block_bytes):
    monkeypatch.setattr(licenses, "BLOCK_BYTES", block_bytes)
    r = random.Random(7)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    noise = [(200 + k, " ".join(r.choice(vocabulary[: 10 + 5 * k]) for _ in range(r.randrange(1, 300)))) for k in range(40)]
    cases = ODD + PLANTED + noise
    templates = licenses.TEMPLATES + [(None, "nothing"), ("none", ""), ("none", "..."), ("one", "solo")]
    found = defaultdict(lambda: [0, [], [], 0])
    for x in licenses.scan(docs_of(cases), spark.createDataFrame(templates, "label string, text string")).collect():
        f = found[x["doc_id"], x["n_words"]]
        f[1] += [tuple(p) for p in x["places"]]
        f[2] += [tuple(b) for b in x["blocks"]]
        f[3] += 1
    parts = min(f[3] for f in found.values())
    assert (parts > 1) == (block_bytes < 1000)
    for i, t in cases:
        n, places, blocks = scanned(t, set(templates))
        f = found[i, n]
        times = f[3] // parts  # rows that repeat
        assert (sorted(f[1]), sorted(f[2])) == (sorted(places * times), sorted(blocks * times)), i


def test_op13(spark, docs_of, tmp_path):
    docs_of(ODD + PLANTED).write.parquet(str(tmp_path / "documents.parquet"))
    got = defaultdict(list)
    for r in licenses.op13_license_scan(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(ODD) + len(PLANTED)
    for i, t in ODD + PLANTED:
        n, places, blocks = scanned(t, licenses.TEMPLATES)
        at = [p for _, p in places]
        want = (n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({a for a, _ in places})), ",".join(sorted({a for a, _ in places} | {b[0] for b in blocks})))
        assert want in [tuple(r)[1:7] for r in got[i]]
        assert all(r["score"] == (1.0 if at else max((b[3] / b[4] for b in blocks), default=0.0)) for r in got[i] if r["n_words"] == n)
    assert got[104][0]["labels"] == "mit" and got[104][0]["n_base"] == 0 and got[105][0]["labels"] == "" and got[101][0]["base_labels"] == "apache"
    docs_of([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert licenses.op13_license_scan(spark, str(tmp_path / "none")).collect() == []
