import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.llm import decontaminate, lm_score, quality, toxicity
from weft.llm.labelled import cut_point, folded, sample

from .conftest import ODD


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [""]


def test_lm_counts_and_base(spark, odd, docs_of, monkeypatch):
    monkeypatch.setattr(lm_score, "KNOWN", 5)  # most words are joined
    docs = lm_score.split(odd)
    rows = lm_score.LanguageModel.train(docs.where("NOT held_out")).score(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in ODD if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in ODD:
        w = words(t)
        want.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert all(-1e9 < r["score"] < 0 for r in rows)


def test_lm_without_training_documents(spark, docs_of):
    docs = lm_score.split(docs_of([(1, "a b"), (2, None)]))
    model = lm_score.LanguageModel.train(docs.limit(0))
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in model.score(docs).collect()} == {(1, 3, 0, 0.0), (2, 1, 0, 0.0)}
    assert model.score(docs.limit(0)).count() == 0


def test_lm_is_normalised(spark, docs_of):
    """Over all symbols, probabilities sum to one; a class's shares are those of its words and one unseen."""
    docs = lm_score.split(docs_of([(k, f"aa bb{k % 5} cc aa dd{k % 3}") for k in range(40)]))
    model = lm_score.LanguageModel.train(docs.where("NOT held_out"))
    m, n = lm_score.Model(model.noise, model.flat), len(model.noise)
    assert m.groups * m.size >= n > (m.groups - 1) * m.size
    before = np.tile(np.array([[3], [1], [2]]), n)
    assert abs((10 ** m.log10(before, np.arange(n))).sum() - 1) < 1e-4
    ends = np.array([lm_score.ending(w) for w in model.known])
    top = np.arange(len(ends)) < model.own
    left = np.zeros(lm_score.CLASSES)
    np.add.at(left, ends[~top], 10 ** model.log_n[~top])
    assert np.allclose(10**model.log_share, left + 1)


def test_lm_score_is_brute_force(spark, docs_of, monkeypatch):
    """Every token's probability by plain loops over the parameters: group, symbol in the group, share of the class."""
    monkeypatch.setattr(lm_score, "KNOWN", 12)
    monkeypatch.setattr(lm_score, "LEAST", 8)
    monkeypatch.setattr(lm_score, "HOT_WORDS", 50)
    long = "y" * 100
    pairs = [(k, " ".join(["aa", f"bb{k % 5}", "cc", f"d{k % 7}", long, "é" * 50 + str(k), "aa"][: 1 + k % 7])) for k in range(60)] + [(90, None), (91, "never seen"), (None, long)]
    docs = lm_score.split(docs_of(pairs))
    model = lm_score.LanguageModel.train(docs.where("NOT held_out"))
    assert len(model.long) == 1 and model.own == 8
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w.encode() for i, t in pairs if not held(i) for w in words(t))
    m = lm_score.Model(model.noise, model.flat)
    own = list(model.known)[: model.own]
    symbol = lambda w: own.index(w) if w in own else model.own + lm_score.ending(w)
    share = Counter()
    for w, n in c.items():
        if w not in own:
            share[lm_score.ending(w)] += n + 1

    def lp(before, w):
        h = [sum(float(m.r[before[j]][x]) * float(m.c[j][x]) for j in range(lm_score.CONTEXT)) for x in range(lm_score.WIDTH)]
        dot = lambda v: sum(a * float(b) for a, b in zip(h, v))
        s, out = symbol(w), 0.0
        g, i = divmod(s, m.size)
        of_group = [dot(m.top[k]) + float(m.top_b[k]) for k in range(m.groups)]
        of_place = [dot(m.q[g][k]) + float(m.b[g][k]) for k in range(m.size) if g * m.size + k < len(model.noise)]
        for scores, k in ((of_group, g), (of_place, i)):
            out += math.log10(math.exp(scores[k]) / sum(map(math.exp, scores)))
        return out if w in own else out + math.log10((c[w] + 1) / (share[lm_score.ending(w)] + 1))

    want = []
    for i, t in pairs:
        before, total = [0] * lm_score.CONTEXT, 0.0
        for w in [x.encode() for x in words(t)]:
            total += lp(before, w)
            before = [symbol(w), *before[:-1]]
        want.append((i, total))
    got = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    assert all(abs(got[i] - x) < 1e-3 * max(1, abs(x)) for i, x in want)


def test_lm_learns(spark, docs_of):
    rng = np.random.default_rng(0)
    docs = lm_score.split(docs_of([(k, " ".join(["tick tock"] * int(rng.integers(20, 200)) if k % 2 else ["la di da"] * int(rng.integers(20, 200)))) for k in range(300)]))
    rows = lm_score.LanguageModel.train(docs.where("NOT held_out")).score(docs).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.5 * sum(r["base_score"] for r in rows)


def test_nce_gradient_matches_its_loss():
    """The gradient that one small step follows is the expected loss's, by differences; many steps raise the likelihood."""
    rng = np.random.default_rng(0)
    noise = rng.random(30) + 0.1
    noise /= noise.sum()
    before, then = rng.integers(0, 30, (lm_score.CONTEXT, 200)), rng.integers(0, 30, 200)
    m = lm_score.Model(noise)

    def loss(flat):
        x = lm_score.Model(noise, flat.astype(np.float64))
        h, total = x.context(before), 0.0
        for s, which, p in [(h @ x.top.T + x.top_b, then // x.size, np.tile(x.p1, (200, 1))), (np.einsum("nw,npw->np", h, x.q[then // x.size]) + x.b[then // x.size], then % x.size, x.p2[then // x.size])]:
            w = lm_score.NOISE * p.astype(np.float64)
            z = s - np.log(np.maximum(w, 1e-30))
            total += np.log1p(np.exp(-z[np.arange(200), which])).sum() + np.where(w > 0, w * np.log1p(np.exp(z)), 0).sum()
        return total / 200

    start = m.flat.copy()
    m.fit([(before, then)])
    step = (start - m.flat).astype(np.float64)
    d = step / lm_score.RATE * 0.1  # the first step divides by about a tenth where gradients are small
    for k in np.flatnonzero(np.abs(step) > 1e-4)[:: max(1, (np.abs(step) > 1e-4).sum() // 25)]:
        e = np.zeros(len(start))
        e[k] = 1e-4
        g = (loss(start + e) - loss(start - e)) / 2e-4
        assert abs(g / np.sqrt(1e-2 + g * g) - d[k] * 10) < 0.02
    first = lm_score.Model(noise, start).log10(before % 4, then % 4).mean()
    m = lm_score.Model(noise, start.copy())
    m.fit([(before % 4, then % 4)] * 60)
    assert m.log10(before % 4, then % 4).mean() > first + 0.5


def edits(item, text):
    """The least word edits of item against any run of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=14), st.lists(st.sampled_from("abcde"), max_size=30))
def test_myers(item, text):
    d, begin, end = decontaminate.Pattern(item).best(text)
    assert d == edits(item, text)
    row = list(range(len(item) + 1))
    for x in text[begin:end]:
        new = [row[0] + 1]
        for i, w in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (w != x)))
        row = new
    assert row[-1] == d


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=40))
def test_every_place_within_the_budget_is_found(items, text):
    block = decontaminate.Block([(k, " ".join(x)) for k, x in enumerate(items)])
    got = {m[0]: m[3] for m in block.matches(" ".join(text))}
    want = {k: d for k, x in enumerate(items) if (d := edits(x, text)) <= int(len(x) * decontaminate.RATE) and text}
    assert got == want


def test_contaminated_rows(spark, odd, docs_of, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item, 9), (1, item, 9), (2, None, 9), (3, "", 9), (None, "Seven times, seven!", 9)], "item_id long, text string, doc_id long")
    docs = odd.unionByName(docs_of([(20, "xx " + item.upper().replace(" ", ", ") + " yy"), (21, item.replace("three", "tree") + " " + item.replace("three ", "")), (22, "one two three seven")]))
    want = [(7, None, 0), (7, None, 0), (20, 1, 0), (21, 1, 1)]
    for block in (8 << 20, 40):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        got = [(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated(docs, bench).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def labelled(k):
    rng = np.random.default_rng(k)
    good = " ".join("".join(rng.choice(list("aeioustrn"), rng.integers(2, 9))) + "." * int(rng.random() < 0.1) for _ in range(int(rng.integers(30, 300))))
    return good if k % 3 else " ".join(f"{w}###" for w in good.split()[:40]) + " " + good[:50]


def test_quality(spark, docs_of, odd):
    docs = folded(docs_of([(k, labelled(k)) for k in range(600)]))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), "x") for k in range(600)] + [(5, None, "x"), (None, 1, "x"), (7, 1, "x")], "doc_id long, quality int, text string")
    model = quality.train(docs, labels)
    rows = [r for r in quality.score(docs, model).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in rows]) > 0.95
    got = quality.score(folded(odd), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    alone = quality.train(docs, labels.where("quality = 1"))
    assert {r["score"] for r in quality.score(docs, alone).collect()} == {1.0}
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_score_is_brute_force(spark, docs_of):
    """A document's score by plain loops: every passage encoded, weighed by gated attention, and summed."""
    docs = folded(docs_of([(k, labelled(k)) for k in range(200)] + [(900, "word " * 700 + "other end"), (901, None)]))
    model = quality.train(docs, spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)], "doc_id long, quality int"))
    p = {k: v.tolist() for k, v in model.p.items()}
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    for i in (0, 1, 2, 5, 900, 901):
        text = {900: "word " * 700 + "other end", 901: ""}.get(i) if i >= 900 else labelled(i)
        w = text.encode().split()
        bag = [" ".join(x.decode() for x in w[k : k + quality.PASSAGE]) for k in range(0, max(1, len(w)), quality.PASSAGE)]
        assert got[i]["n_passages"] == len(bag)
        e, hidden = [], []
        for x in ((quality.passages(text.encode()) - model.mean) / model.scale).tolist():
            h = [math.tanh(sum(a * row[j] for a, row in zip(x, p["W"])) + p["b"][j]) for j in range(quality.WIDTH)]
            t = [math.tanh(sum(a * row[j] for a, row in zip(h, p["V"]))) for j in range(quality.GATE)]
            g = [1 / (1 + math.exp(-sum(a * row[j] for a, row in zip(h, p["U"])))) for j in range(quality.GATE)]
            e.append(math.exp(sum(a * b * c for a, b, c in zip(t, g, p["w"]))))
            hidden.append(h)
        z = [sum(a * h[j] for a, h in zip(e, hidden)) / sum(e) for j in range(quality.WIDTH)]
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["u"])) - p["c"][0]))) < 1e-6


def test_samples_are_whole_and_bounded(spark, docs_of):
    docs = docs_of([(k, "x" * (10 * k)) for k in range(1, 60)]).select("doc_id", "text")
    labels = spark.createDataFrame([(k, 1) for k in range(1, 60)], "doc_id long, quality int")
    rows = sample(docs, labels, "quality", 50, 2000).collect()
    assert sum(len(r["text"]) for r in rows) <= 2000 and all(len(r["text"]) == 10 * r["doc_id"] for r in rows) and len(rows) > 5
    assert sample(docs, labels, "quality", 50, 0).count() == 0 and 20 < sample(docs, labels, "quality", 50).count() <= 50


def test_quality_gradients():
    m, rng = quality.Attention(), np.random.default_rng(0)
    x, begin, y = rng.normal(0, 1, (9, quality.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.sum(np.log(np.where(y > 0, (p := m.forward(x, begin)["y"]), 1 - p)))
    f = m.forward(x, begin)
    assert np.allclose(np.add.reduceat(f["a"], begin), 1)
    g = m.grads(f, begin, f["y"] - y)
    for name, p in m.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[name][at]) < 1e-6, name
        p[at] += 1e-5


def test_toxicity(spark, docs_of, odd):
    bad = ["scumbag", "loserish", "vileness"]
    text = lambda k: labelled(3 * k + 1) + (f" {bad[k % 3]} and so {bad[k % 2]}" if k % 4 == 0 else "")
    docs = docs_of([(k, text(k)) for k in range(800)])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(800)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = [r for r in toxicity.score(docs, model).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows]) > 0.95
    got = toxicity.score(odd.withColumn("lang", F.when(F.col("doc_id") > 5, F.col("lang"))), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.5}


def test_tabled_responses_are_convolutions():
    m = toxicity.Convolution()
    m.prepare()
    texts = [toxicity.hashed(t.encode()) for t in ("a bad day for it", "", "one")]
    got = m.responses(texts)
    for t, row in zip(texts, got):
        e, want = m.e[t].sum(1), []
        for w in toxicity.WIDTHS:
            places = [np.concatenate(e[i : i + w]) for i in range(len(e) - w + 1)]
            want += np.maximum(0, np.max([p @ m.p[f"f{w}"] for p in places], 0)).tolist()
        assert np.allclose(row, want, atol=1e-4)


def test_toxicity_score_is_brute_force(spark, docs_of, monkeypatch):
    """Every filter at every place of a text by plain loops, also where a text is read in pieces."""
    monkeypatch.setattr(toxicity, "RUN", 7)
    rng = np.random.default_rng(0)
    some = lambda: " ".join(f"w{rng.integers(40)}" for _ in range(int(rng.integers(0, 30))))
    rows = [(k, some() + (" vile" if k % 2 else "")) for k in range(120)]
    docs = docs_of(rows)
    model = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, toxic int"))
    model.prepare()
    e, got = model.e.tolist(), toxicity.Convolution.score(model, [toxicity.hashed(t.encode()) for _, t in rows])
    for k, (_, t) in enumerate(rows[:25]):
        words, z = [[sum(e[i][d] for i in row) for d in range(toxicity.WIDTH)] for row in toxicity.hashed(t.encode()).tolist()], float(model.p["c"][0])
        for a, w in enumerate(toxicity.WIDTHS):
            f = model.p[f"f{w}"].tolist()
            for j in range(toxicity.FILTERS):
                best = max([0.0] + [sum(words[i + d // toxicity.WIDTH][d % toxicity.WIDTH] * f[d][j] for d in range(w * toxicity.WIDTH)) for i in range(len(words) - w + 1)])
                z += best * float(model.p["u"][a * toxicity.FILTERS + j])
        assert abs(got[k] - 1 / (1 + math.exp(-(model.scale * z + model.shift)))) < 1e-4


def test_cut_point():
    assert cut_point(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.5)
    assert cut_point(np.array([]), np.array([])) == 0.5


def test_toxicity_learns_from_long_texts_in_pieces(monkeypatch):
    """Maxima found by pieces are those of whole texts, found by plain loops; so a step's memory doesn't grow with a text's length."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    texts = [toxicity.hashed(" ".join(rng.choice(words, n)).encode()) for n in (1, 2, 0, 700, 3, 40, 5000)]
    m = toxicity.Convolution()
    many = np.array([len(t) for t in texts])
    begin, ids = np.cumsum(many) - many, np.concatenate(texts)
    rows = np.concatenate([ids, np.full((max(toxicity.WIDTHS), toxicity.PARTS), toxicity.PAD, ids.dtype)])
    for run in (37, 1 << 16):
        monkeypatch.setattr(toxicity, "RUN", run)
        found = m.maxima(rows, begin, many)
        for w in toxicity.WIDTHS:
            e = m.embedded(rows)
            for k, (a, n) in enumerate(zip(begin, many)):
                r = np.stack([e[a + i : a + i + w].ravel() @ m.p[f"f{w}"] if i + w <= n else np.zeros(toxicity.FILTERS) for i in range(n)])
                assert np.allclose(found[w][0][k], r.max(0)) and np.allclose(r[found[w][1][k] - a, range(toxicity.FILTERS)], r.max(0))
    y, one = np.array([0, 1, 0, 1, 0, 1, 1.0]), {}
    for run in (37, 1 << 16):
        monkeypatch.setattr(toxicity, "RUN", run)
        m = toxicity.Convolution()
        m.step(texts, y, toxicity.Adam(m.p, 0.01), np.full(m.e.shape, 1e-4))
        one[run] = np.concatenate([m.e.ravel(), *(m.p[k].ravel() for k in sorted(m.p))])
    assert np.allclose(one[37], one[1 << 16])
