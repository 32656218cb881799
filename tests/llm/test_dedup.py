import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.bucketed import SORTED, Bucketed
from weft.llm import common, components, exact_dedup, near_copies, simhash
from weft.store import scratch

from .conftest import ODD


def normalised(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_on_odd_rows(spark, odd):
    got = exact_dedup.DigestIndex(spark, scratch(spark, "i"), 4).dedup(odd).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(normalised(t), []).append(i)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert (r["keep_id"], r["group_size"]) == (min(known) if known else None, len(ids))
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(by_hash) and len({r["text_sha256"] for r in kept}) == len(kept)


def test_exact_in_batches(spark, docs_of):
    path = scratch(spark, "i")
    index = exact_dedup.DigestIndex(spark, path, 4)
    assert index.dedup(docs_of([])).count() == 0 and index.rows().count() == 0
    assert {r["doc_id"]: r["kept"] for r in index.dedup(docs_of([(5, "a b"), (6, "c")])).collect()} == {5: True, 6: True}
    again = exact_dedup.DigestIndex(spark, path, 4)
    got = {r["doc_id"]: (r["kept"], r["keep_id"]) for r in again.dedup(docs_of([(1, "a  b"), (2, "d"), (3, "d")])).collect()}
    assert got == {1: (False, 5), 2: (True, 2), 3: (False, 2)}
    assert again.rows().count() == 3


def test_a_batch_that_runs_again_gives_the_same_rows(spark, docs_of):
    path, b = scratch(spark, "i"), docs_of([(1, "a b"), (2, "a  b"), (3, "c")])
    first = sorted(exact_dedup.DigestIndex(spark, path, 4).dedup(b, "monday").collect())
    assert [r["kept"] for r in first] == [True, False, True]
    assert sorted(exact_dedup.DigestIndex(spark, path, 4).dedup(b, "monday").collect()) == first
    assert not any(r["kept"] for r in exact_dedup.DigestIndex(spark, path, 4).dedup(b, "tuesday").collect())
    assert sorted(exact_dedup.DigestIndex(spark, path, 4).dedup(b, "monday").collect()) == first
    assert exact_dedup.DigestIndex(spark, path, 4).rows().count() == 2
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("weft_")]
    assert spark.conf.get(SORTED, None) is None


@pytest.mark.parametrize("at", ["write 1", "write 2", "write 3", "publish", "compact"])
def test_a_batch_that_is_killed_and_runs_again(spark, docs_of, monkeypatch, at):
    """Whatever step it is killed at, the batch run again gives the rows that it would have given, and so do later ones."""
    path = scratch(spark, "i")
    exact_dedup.DigestIndex(spark, path, 4).dedup(docs_of([(1, "a"), (2, "b")]), "before")
    b, steps = docs_of([(3, "b"), (4, "c"), (5, "c"), (6, "d")]), []

    def killed(name, whole):
        def run(*args):
            steps.append(name)
            if at in (name, f"{name} {steps.count(name)}"):
                if name == "write":
                    whole(*args)  # killed after its work
                raise KeyboardInterrupt
            return whole(*args)

        return run

    with monkeypatch.context() as m:
        m.setattr(Bucketed, "write", killed("write", Bucketed.write))
        m.setattr(Bucketed, "publish", killed("publish", Bucketed.publish))
        m.setattr(exact_dedup.DigestIndex, "compact", killed("compact", exact_dedup.DigestIndex.compact))
        m.setattr(exact_dedup, "FILES", 0)
        with pytest.raises(KeyboardInterrupt):
            exact_dedup.DigestIndex(spark, path, 4).dedup(b, "killed")
    again = exact_dedup.DigestIndex(spark, path, 4).dedup(b, "killed").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["keep_id"], r["kept"]) for r in again] == [(3, 2, False), (4, 4, True), (5, 4, False), (6, 6, True)]
    index = exact_dedup.DigestIndex(spark, path, 4)
    index.compact()
    later = index.dedup(docs_of([(7, "d"), (8, "e")])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["keep_id"], r["kept"]) for r in later] == [(7, 6, False), (8, 8, True)]
    assert index.rows().count() == 5 and index.rows().select("digest").distinct().count() == 5


def test_index_is_compacted(spark, docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILES", 2)
    path = scratch(spark, "i")
    for k in range(6):
        index = exact_dedup.DigestIndex(spark, path, 2)
        got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.dedup(docs_of([(10 * k + j, f"t{j} {k // 2}") for j in range(8)])).collect()}
        assert got == {10 * k + j: (10 * (k // 2 * 2) + j, k % 2 == 0) for j in range(8)}
    assert len({r["folder"] for r in index.table.meta()}) > 1 and index.rows().count() == 24
    index.compact()
    with index.table.tables() as known:
        one = lambda: spark.table(known(f"{path}/{index.table.meta()[-1]['folder']}", 2)).hint("merge")
        plan = one().join(one(), "digest")._jdf.queryExecution().toString()
    assert len(index.rows().inputFiles()) == 2 and "SortMergeJoin" in plan
    assert not any(x in plan.split("Physical Plan")[1] for x in ("Exchange", "Sort ["))
    index.given = 5
    index.compact()
    assert len(index.rows().inputFiles()) == 5 and index.rows().count() == 24


def test_exact_stage_keeps_columns_and_one_of_repeats(spark, odd):
    left = exact_dedup.stage(spark, odd, "")
    assert left.columns == odd.columns
    assert sorted(normalised(r["text"]) for r in left.collect() if r["doc_id"] is not None) == sorted({normalised(t) for i, t in ODD if i is not None})


def test_hot_groups_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 0, id) AS k")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k + 1 AS v")
    got = common.lookup(rows, groups, "k", 2000).collect()
    assert len(got) == 2000 and all(r["v"] == r["k"] + 1 for r in got)


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(points, near):
    """The smallest index reachable."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if near(points[i], points[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def test_fingerprints():
    for _, t in ODD:
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4), st.integers(6, 12))
def test_a_near_pair_shares_a_cell(a, flips, groups):
    b = a
    for k in flips:
        b ^= 1 << k
    e = simhash._embedded(np.array([a, b], np.uint64))
    assert int(np.bitwise_count(e[0] ^ e[1])) <= (a ^ b).bit_count()
    assert any((int(e[0]) ^ int(e[1])) & m % (1 << 64) == 0 for m in simhash.subspaces(groups))


def test_rows_of_a_fingerprint_stay_few():
    rows = [len(simhash.subspaces(simhash.groups_for(n))) for n in (10, 10**6, 10**7, 10**8, 10**9, 5 * 10**10)]
    assert rows == [15, 15, 15, 15, 35, 126]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 63), max_size=9)), max_size=40))
def test_forest_connects_what_is_near(spec):
    base = [0x0123456789ABCDEF, 0xFFFF0000FFFF0000, 0, 0x5555AAAA5555AAAA]
    fp = []
    for k, flips in spec:
        x = base[k]
        for b in flips:
            x ^= 1 << b
        fp.append(x)
    fp = sorted(set(fp))
    u, v = simhash.forest(np.array(fp, np.uint64))
    pairs = {frozenset((int(a), int(b))) for a, b in zip(u, v)}
    assert all((fp[a] ^ fp[b]).bit_count() <= 4 for a, b in zip(u, v))
    want = roots(fp, lambda a, b: (a ^ b).bit_count() <= 4)
    assert roots(range(len(fp)), lambda i, j: frozenset((i, j)) in pairs) == want and len(u) == len(fp) - len(set(want))


@pytest.mark.parametrize("cell", [4096, 10])
def test_links_of_a_dense_group(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(0)
    fp = {0}
    for k in range(300):
        x = int(rng.integers(0, 2**63)) if k % 3 == 0 else 0x00FF00FF00FF00FF
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= 1 << int(b)
        fp.add(x)
    fp = sorted(fp)
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {frozenset((r["u"], r["v"])) for r in simhash.links(df).collect()}
    assert all((int(a) % 2**64 ^ int(b) % 2**64).bit_count() <= 64 for a, b in map(tuple, found))
    got = roots(signed, lambda a, b: frozenset((a, b)) in found)
    assert got == roots(fp, lambda a, b: (a ^ b).bit_count() <= 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (100, 98), (7, 7), (60, 61), (61, 60)]
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {99: 98, 100: 98, 61: 60}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_dedup_on_odd_rows(spark, odd, docs_of):
    got = simhash.near_dedup(odd).collect()
    assert len(got) == len(ODD)
    fp = [brute_fingerprint(t) for _, t in ODD]
    assert sorted(r["fingerprint"] for r in got) == sorted(format(x, "016x") for x in fp)
    root = roots(fp, lambda a, b: (a ^ b).bit_count() <= 4)
    want = {}
    for (i, _), r, x in zip(ODD, root, fp):
        ids = [j for (j, _), s in zip(ODD, root) if s == r and j is not None]
        want[(i, format(x, "016x"))] = min(ids) if ids else None
    assert {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got} == want
    assert simhash.near_dedup(docs_of([])).count() == 0


def jaccard(a, b):
    s, t = (set(near_copies.hashes(x.encode())[1].tolist()) for x in (a, b))
    return len(s & t) / len(s | t)


def edited(rng, w, share):
    return " ".join(f"z{rng.integers(10**6)}" if rng.random() < share else x for x in w)


def test_near_copies_are_those_of_similarity(spark, docs_of):
    rng = np.random.default_rng(0)
    pairs = []
    for k in range(120):
        w = [f"w{rng.integers(3000)}" for _ in range(int(rng.integers(60, 400)))]
        pairs.append((" ".join(w), edited(rng, w, [0.004, 0.01, 0.02, 0.06, 0.2][k % 5])))
    docs = docs_of([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    found = [got[2 * k + 1] == 2 * k for k in range(120)]
    j = np.array([jaccard(*p) for p in pairs])
    assert not any(f for f, x in zip(found, j) if x < 0.8)
    assert np.mean([f for f, x in zip(found, j) if x >= 0.9]) > 0.95 and np.mean([f for f, x in zip(found, j) if x >= 0.8]) > 0.85
    assert all(c in (i, i - i % 2) for i, c in got.items())


@pytest.mark.parametrize("cell", [4096, 20])
def test_a_large_group_of_near_copies_is_one(spark, docs_of, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(0)
    w = [f"w{k}" for k in range(300)]
    docs = docs_of([(k, edited(rng, w, 0.003)) for k in range(150)] + [(1000 + k, f"alone {k} " * 30) for k in range(20)])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert all(got[k] == 0 for k in range(150)) and all(got[1000 + k] == 1000 + k for k in range(20))


@pytest.mark.parametrize("cell", [4096, 20])
def test_near_copies_inside_a_family_are_found(spark, docs_of, monkeypatch, cell):
    """Texts of about 0.7 share most shingles, and each has a copy of a little over 0.8."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(1)
    w = [f"w{k}" for k in range(300)]
    family = [edited(rng, w, 0.018).split() for _ in range(60)]
    rows = [t for f in family for t in (" ".join(f), edited(rng, f, 0.018))]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs_of(list(enumerate(rows)))).collect()}
    want = roots(rows, lambda a, b: jaccard(a, b) >= 0.8)
    assert 20 < len(set(want)) < 110 and [got[k] for k in range(len(rows))] == want


@pytest.mark.parametrize("side", [256, 16])
def test_texts_near_a_large_group_are_not_paired_with_each_member(spark, docs_of, monkeypatch, side):
    """Sixty texts about a group of a hundred near copies, some in reach of a few members only: all links, and few pairs to compare."""
    monkeypatch.setattr(near_copies, "SIDE", side)
    rng = np.random.default_rng(3)
    w = [f"w{k}" for k in range(300)]
    core = [edited(rng, w, 0.003) for _ in range(100)]
    rows = core + [edited(rng, core[k].split(), 0.028) for k in range(60)]
    similar, compared = near_copies.similar, []

    def counting(docs, pairs, *rest):
        compared.append(pairs.count())
        return similar(docs, pairs, *rest)

    monkeypatch.setattr(near_copies, "similar", counting)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs_of(list(enumerate(rows)))).collect()}
    want = roots(rows, lambda a, b: jaccard(a, b) >= 0.8)
    assert 5 < len(set(want)) < 55 and [got[k] for k in range(len(rows))] == want
    assert sum(compared[1:]) < 3000, compared


def test_short_near_copies_are_found(spark, docs_of):
    """Of n words and one word more: n - 4 of n - 3 shingles are shared."""
    words = [f"{k}-{j}" for k in range(120) for j in range(8 + k % 3)]
    lines = [" ".join(x for x in words if x.startswith(f"{k}-")) for k in range(120)]
    docs = docs_of([(2 * k + j, t) for k, x in enumerate(lines) for j, t in enumerate((x, x + " more"))])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert all(c == i - i % 2 for i, c in got.items())


def test_near_copies_on_odd_rows(spark, odd, docs_of):
    got = {(r["doc_id"], r["component_id"]) for r in near_copies.near_copies(odd).collect()}
    assert {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 3), (6, 3), (7, 7), (8, 8)} <= got
    assert near_copies.near_copies(docs_of([])).count() == 0


def test_near_stage_keeps_one(spark, docs_of):
    long = " ".join(f"w{k % 97}x{k % 31}" for k in range(800))
    docs = docs_of([(4, long), (2, long + " more"), (9, "something else entirely here now"), (5, None), (6, "")])
    left = near_copies.stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 5, 9] and left.columns == docs.columns


def test_near_copies_are_brute_force_on_a_table(spark):
    """All pairs of 0.8 and more among the table's texts, by counting shared shingles of strings."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets.append(frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    having, shared = {}, {}
    for k, s in enumerate(sets):
        for x in s:
            for j in having.setdefault(x, []):
                shared[(j, k)] = shared.get((j, k), 0) + 1
            having[x].append(k)
    near = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    empty = [k for k, s in enumerate(sets) if not s]
    near |= set(zip(empty, empty[1:]))
    distinct = sum(sets[a] != sets[b] for a, b in near)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert got == {i: rows[find(k)][0] for k, (i, _) in enumerate(rows)} and len(near) > distinct > 0


@pytest.mark.parametrize("values", [256, 2])
def test_sketches_exclude_no_similar_pair(spark, monkeypatch, values):
    """With two values counts pass 255, which then excludes nothing."""
    monkeypatch.setattr(near_copies, "SKETCH", values)
    rng, sets = np.random.default_rng(4), []
    for k in range(60):
        base = rng.integers(0, 2**63, [40, 700, 2000][k % 3], dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: int(len(base) * rng.uniform(0.7, 1))], rng.integers(0, 2**63, len(base) // 12, dtype=np.uint64)]))]
    sketches = spark.createDataFrame([(c, len(s), bytearray(near_copies.sketch(s))) for c, s in enumerate(sets)], "c long, size long, sketch binary")
    pairs = [(u, v) for u in range(len(sets)) for v in range(u + 1, min(len(sets), u + 8))]
    got = {(r["u"], r["v"]) for r in near_copies.plausible(spark.createDataFrame(pairs, "u long, v long"), sketches, 0.8).collect()}
    alike = lambda u, v: len(np.intersect1d(sets[u], sets[v])) / len(np.union1d(sets[u], sets[v])) >= 0.8
    want = {p for p in pairs if alike(*p)}
    assert want <= got and len(want) > 10 and (values == 2 or len(got) < 0.5 * len(pairs))
