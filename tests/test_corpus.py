"""Scans, samples, batches, schedules, losses and the sequence model."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions.schedule import early_stopping, minutes, teacher_forcing
from weft.operators import dataset, seq2seq, synchronous
from weft.plans import corpus_queries
from weft.sources import batch_files, model_files, pairs


def test_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('en,fr,more\nNone,a,1\nNA,b,1\n nan ,c,1\n"say ""x""","two\nlines",1\nd,e,\n')
    got = [tuple(r) for r in pairs.pair_csv(spark, str(path)).collect()]
    assert sorted(got) == [(" nan ", "c"), ('say "x"', "two\nlines")]


def test_tsv(spark, tmp_path):
    path = tmp_path / "p.tsv"
    path.write_text("\n\nonly\na\tb\nc\td\te\nf\tg\n\n")
    got = lambda n: [tuple(r) for r in pairs.pair_tsv(spark, str(path), n).orderBy("pair_id").collect()]
    assert got(2) == [(1, "a", "b")]
    assert got(0.75) == [(1, "a", "b"), (2, "c", "d")]
    assert len(got(100)) == 3 and got(0) == []
    for bad in (0.0, 1.5, -1, True, "x"):
        with pytest.raises(ValueError):
            pairs.line_limit(5, bad)


def test_ordinals(spark):
    t = pairs.with_ordinals(spark.range(1000).select((999 - F.col("id")).alias("k")), "n", "k")
    assert all(r["n"] == r["k"] + 1 for r in t.collect()) and t.count() == 1000


def test_first_per_key(spark):
    t = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id int, src string")
    assert sorted(r["id"] for r in dataset.first_per_key(t, "src", "id").collect()) == [1, 2, 4]


def test_split_of_few(spark):
    t = dataset.split(spark.range(9), "id")
    assert t.where("part = 'val'").count() == 0 and t.count() == 9
    assert dataset.epoch_loss(spark.createDataFrame([], "batch_id long, loss double")).head()["loss"] is None


def test_chunks(spark):
    got = dataset.chunks(spark.range(10), 4, "id").groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == [3, 3, 2, 2]
    assert sorted(r["chunk"] for r in dataset.chunks(spark.range(3), 7, "id").collect()) == [1, 2, 3]


def test_schedule(spark):
    got = {r["id"]: r["x"] for r in spark.range(30).select("id", teacher_forcing(F.col("id"), 1.0, 0.0, 5, 20).alias("x")).collect()}
    assert (got[0], got[5], got[20], got[29]) == (1.0, 1.0, 0.0, 0.0) and abs(got[10] - 2 / 3) < 1e-12


def test_early_stopping(spark):
    losses = spark.createDataFrame([(0, k + 1, x) for k, x in enumerate((1.0, 0.5, 0.495, 0.6, 0.1))], "run int, epoch int, loss double")
    r = early_stopping(losses, 0.01, 2, 3).head()
    assert (r["stop_epoch"], r["best_epoch"], r["kept_epoch"]) == (4, 2, 2)
    r = early_stopping(losses, 0.01, 9, 3).head()
    assert (r["stop_epoch"], r["best_epoch"], r["kept_epoch"]) == (None, 5, 5)


def test_minutes(spark):
    assert spark.range(1).select(minutes(F.lit(125.9)).alias("x")).head()["x"] == "2m 5s"


def test_vocabulary_and_padding(spark):
    tokens = spark.createDataFrame([("b",), ("a",), ("b",)], "token string")
    vocab = dataset.vocabulary(tokens)
    assert {r["token"]: r["id"] for r in vocab.collect()} == {"a": 4, "b": 5}
    more = dataset.add_tokens(vocab, spark.createDataFrame([("a",), ("0",)], "token string"))
    assert {r["token"]: r["id"] for r in more.collect()} == {"a": 4, "b": 5, "0": 6}
    enc = spark.createDataFrame([(1, ["a", "x", "b"]), (2, []), (3, ["b"])], "k long, tokens array<string>")
    got = {r["k"]: r["ids"] for r in dataset.ids(enc, vocab, "k").collect()}
    assert got == {1: [4, 3, 5], 2: [], 3: [5]}
    with pytest.raises(Exception, match="no id for token x"):
        dataset.ids(enc, vocab, "k", strict=True).collect()
    ex = dataset.ids(enc, vocab, "k").select("k", dataset.source_example(F.col("ids")).alias("src"), dataset.target_example(F.col("ids")).alias("tgt"))
    rows = {r["k"]: r for r in dataset.padded(dataset.batched(ex, "k", 2), "src", "tgt").collect()}
    assert rows[1]["src"] == [4, 3, 5, 2] and rows[2]["src"] == [2, 0, 0, 0] and rows[2]["tgt"] == [1, 2, 0, 0, 0] and rows[3]["src"] == [5, 2]
    assert (rows[3]["batch_id"], rows[3]["pos_in_batch"]) == (1, 0)


def test_masked_loss(spark):
    rows = [(0, 1, [0.0, 1.0, 2.0]), (0, 0, [9.0, 0.0, 0.0]), (0, 2, [0.0, 0.0, 0.0]), (1, 0, [1.0, 1.0, 1.0])]
    got = {r["batch_id"]: r["loss"] for r in dataset.masked_loss(spark.createDataFrame(rows, "batch_id long, target int, logits array<double>")).collect()}
    assert abs(got[0] - (np.log(np.exp([0, 1, 2]).sum()) - 1 + np.log(3)) / 2) < 1e-12 and got[1] is None


def test_gradients():
    m = seq2seq.Seq2Seq(7, 6, hidden=3, layers=2, embedding=4)
    src, tgt = seq2seq.matrix([[4, 5, 2], [6, 2]]), seq2seq.matrix([[1, 4, 5, 2], [1, 4, 2]])
    _, grads = m.step(src, tgt, 1.0, None)
    rng = np.random.default_rng(0)
    for name, p in m.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape)
        loss = []
        for d in (1e-5, -2e-5):
            p[at] += d
            loss.append(m.loss(m.forward(src, tgt, 1.0), tgt[:, 1:])[0])
        p[at] += 1e-5
        assert abs((loss[0] - loss[1]) / 2e-5 - grads[name][at]) < 1e-6, name


def test_steps_equal_one_pass():
    m = seq2seq.Seq2Seq(7, 6, hidden=3, layers=2, embedding=4)
    src, tgt = seq2seq.matrix([[4, 5, 2], [6, 2]]), seq2seq.matrix([[1, 4, 5, 2], [1, 4, 2]])

    class Always:
        def random(self):
            return 0.0

    assert np.allclose(m.forward(src, tgt, 1.0), m.forward(src, tgt, 0.999, Always()))
    assert m.forward(src, tgt, 0.0).shape == (2, 3, 6)


def test_training_lowers_the_loss():
    data = [([4 + k % 3, 2], [1, 4 + k % 3, 2]) for k in range(30)]
    m = seq2seq.Seq2Seq(8, 8, hidden=8, layers=1, embedding=6)
    rows = seq2seq.fit(m, data[:24], data[24:], epochs=25, size=8, rate=0.03, share=1.0, tf=(1.0, 0.0, 10, 25), patience=50)
    assert rows[-1]["val_loss"] < 0.3 < rows[0]["val_loss"]
    assert seq2seq.fit(m, data, [], epochs=1)[0]["val_loss"] is None


def test_forward_covers_whole_texts(spark, tmp_path):
    texts = [("user", "ab" * 20), ("assistant", "cd" * 30), ("user", "b"), ("assistant", "a d")]
    spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    ids = {c: k + 4 for k, c in enumerate(sorted(set("".join(t for _, t in texts))))}
    of = lambda role: [[ids[c] for c in t] for r, t in texts if r == role]
    src, tgt = seq2seq.matrix([[*x, 2] for x in of("user")]), seq2seq.matrix([[1, *x, 2] for x in of("assistant")])
    m = seq2seq.Seq2Seq(len(ids) + 4, len(ids) + 4, hidden=8, layers=2, embedding=6)
    want = m.loss(m.forward(src, tgt, 0.0), tgt[:, 1:])[0]
    got = corpus_queries.seq2seq_forward(spark, str(tmp_path)).collect()
    assert len(got) == 1 and abs(got[0]["loss"] - want) < 1e-5 and (got[0]["n_labels"], got[0]["n_greedy"]) == (61 + 4, 2 * 61)


def test_weights(spark, tmp_path):
    m = seq2seq.Seq2Seq(5, 5, hidden=2, layers=1, embedding=3)
    model_files.save_weights(spark, m.p, str(tmp_path / "w"))
    back = model_files.load_weights(spark, str(tmp_path / "w"))
    assert all((back[k] == v.astype("float32")).all() for k, v in m.p.items())


@pytest.mark.parametrize("edge, digits", [(10_000, 4), (3, 1)])
def test_first_by_hash(spark, monkeypatch, edge, digits):
    monkeypatch.setattr(dataset, "EDGE", edge)
    monkeypatch.setattr(dataset, "DIGITS", digits)
    table = spark.range(300).selectExpr("id AS k", "'x' AS __v")
    order = sorted(range(300), key=lambda k: (hashlib.md5(f"{k}-5".encode()).hexdigest(), k))
    for n in (0, 1, 7, 150, 299, 300, 5000):
        got = dataset.first_by_hash(table, "k", n, 5)
        assert sorted(r["k"] for r in got.collect()) == sorted(order[:n]) and got.columns == table.columns
    assert dataset.first_by_hash(table.limit(0), "k", 3, 5).count() == 0


def test_ids_are_made_in_place(spark):
    rows = [(1, ["a", "zz", "b"]), (2, []), (3, None), (4, ["b"])]
    encoded = spark.createDataFrame(rows, "k long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id int")
    want = {1: [4, 3, 5], 2: [], 3: [], 4: [5]}
    for how in (dataset.ids, dataset.ids_by_join):
        assert {r["k"]: r["ids"] for r in how(encoded, vocab, "k").collect()} == want
        with pytest.raises(Exception, match="no id for token"):
            how(encoded, vocab, "k", True).collect()
    plan = dataset.ids(encoded, vocab, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_distributed_training(spark, monkeypatch):
    """By shards it lowers the loss and repeats itself; more shards than are averaged at a time."""
    monkeypatch.setattr(seq2seq, "SHARD", 30)
    monkeypatch.setattr(seq2seq, "AVERAGED", 2)
    data = [(k, [4 + k % 3, 4 + k % 2, 2], [1, 4 + k % 3, 4 + k % 2, 2], "train" if k % 10 else "val") for k in range(100)]
    table = spark.createDataFrame(data, "pair_id long, src array<int>, tgt array<int>, part string")
    run = lambda: seq2seq.fit_distributed(seq2seq.Seq2Seq(8, 8, hidden=8, layers=1, embedding=6), table, epochs=10, size=4, rate=0.03, share=1.0, tf=(1.0, 1.0, 0, 1), patience=50)
    rows = run()
    assert rows[-1]["train_loss"] < 0.7 * rows[0]["train_loss"] and rows[-1]["val_loss"] < rows[0]["val_loss"] and rows == run()


def test_steps_are_plain_loops():
    """One source and target through both layers, each gate written out: the logits are the model's."""
    m = seq2seq.Seq2Seq(7, 6, hidden=3, layers=2, embedding=4)
    source, target = [4, 5, 6, 2], [1, 4, 5, 2]
    s = lambda x: 1 / (1 + math.exp(-x))

    def step(name, x, h, c):
        wx, wh, b = (m.p[f"{name}.{k}"].tolist() for k in ("wx", "wh", "b"))
        n = len(h)
        z = [sum(v * wx[i][j] for i, v in enumerate(x)) + sum(v * wh[i][j] for i, v in enumerate(h)) + b[j] for j in range(4 * n)]
        c = [s(z[n + j]) * c[j] + s(z[j]) * math.tanh(z[2 * n + j]) for j in range(n)]
        return [s(z[3 * n + j]) * math.tanh(c[j]) for j in range(n)], c

    def way(name, xs):
        h, c, out = [0.0] * 3, [0.0] * 3, []
        for x in xs:
            h, c = step(name, x, h, c)
            out.append(h)
        return out, h, c

    xs, states = [m.p["source"][i].tolist() for i in source], []
    for k in range(2):
        f, fh, fc = way(f"enc{k}.fwd", xs)
        b, bh, bc = way(f"enc{k}.bwd", xs[::-1])
        states.append((fh + bh, fc + bc))
        xs = [x + y for x, y in zip(f, b[::-1])]
    for t, i in enumerate(target[:-1]):
        x = m.p["target"][i].tolist()
        for k in range(2):
            h, c = step(f"dec{k}", x, *states[k])
            states[k], x = (h, c), h
        want = [sum(v * w for v, w in zip(x, col)) + b for col, b in zip(m.p["out.w"].T.tolist(), m.p["out.b"].tolist())]
        got = m.forward(seq2seq.matrix([source]), seq2seq.matrix([target]))[0, t]
        assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from weft import store

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda k, d: None)}), Context

    with pytest.raises(ValueError):
        store.shared_dir(Session)
    path = store.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert path.startswith(store.own_dir(spark))


def test_batch_files(spark, tmp_path):
    rows = [(k, k // 3, k % 3, [k] * (1 + k % 4), [1, k, 2]) for k in range(20)]
    table = spark.createDataFrame(rows, "pair_id long, batch_id long, pos_in_batch long, src array<int>, tgt array<int>")
    want = dataset.padded(table, "src", "tgt")
    path = str(tmp_path / "b")
    batch_files.write_batches(want, path, "pair_id", "src", "tgt")
    back = batch_files.read_rows(spark, path, "pair_id")
    order = ["pair_id", "batch_id", "pos_in_batch", "src", "tgt"]
    assert sorted(back.select(order).collect()) == sorted(want.select(order).collect())
    b = batch_files.read_batch(spark, path, 6)
    assert b["keys"].tolist() == [18, 19] and b["src"].tolist() == [[18, 18, 18, 0], [19, 19, 19, 19]] and b["tgt"].tolist() == [[1, 18, 2], [1, 19, 2]]
    assert batch_files.read_batch(spark, path, 99) is None
    batch_files.write_batches(want.limit(0), path + "0", "pair_id", "src", "tgt")
    assert batch_files.read_rows(spark, path + "0", "pair_id").count() == 0 and batch_files.read_batch(spark, path + "0", 0) is None


def _training_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [int(x) for x in rng.integers(4, 8, 1 + k % 5)] + [2], [1, *(int(x) for x in rng.integers(4, 8, 1 + k % 3)), 2], "val" if k % 7 == 0 else "train") for k in range(40)]
    return rows, spark.createDataFrame(rows, "pair_id long, src array<int>, tgt array<int>, part string")


def test_shared_steps_are_those_of_one_process(spark, tmp_path):
    """Two shards, by a barrier stage: parameters equal to a plain loop over whole batches, and the draws are those of bootstrap."""
    rows, table = _training_pairs(spark)
    make = lambda: seq2seq.Seq2Seq(8, 8, hidden=4, layers=2, embedding=3, seed=1)
    m = make()
    got = synchronous.fit_synchronous(m, table, str(tmp_path / "g"), epochs=3, size=8, rate=0.02, tf=(1.0, 0.0, 0, 3), seed=9, shards=2)
    plain = make()
    opt, train = seq2seq.AdamW(plain.p, 0.02), {r[0]: r for r in rows if r[3] == "train"}
    for epoch in range(3):
        order = dataset.bootstrap(table.where("part = 'train'"), "pair_id", 0.7, epoch, 9).orderBy("draw").collect()
        own = [train[r["pair_id"]] for r in order]
        drawn = synchronous.drawn(table.where("part = 'train'"), epoch, 0.7, 8, 9).select("draw", F.expr("filter(src, x -> x <> 0)").alias("s"), F.expr("filter(tgt, x -> x <> 0)").alias("t"))
        assert [(r["s"], r["t"]) for r in drawn.orderBy("draw").collect()] == [(r[1], r[2]) for r in own] and len(own) == int(0.7 * len(train))
        losses, ratio = [], 1 - epoch / 3
        for step, i in enumerate(range(0, len(own), 8)):
            few = own[i : i + 8]
            loss, grads = plain.step(seq2seq.matrix([r[1] for r in few]), seq2seq.matrix([r[2] for r in few]), ratio, np.random.default_rng([9, epoch, step]))
            opt.step(grads)
            losses.append(loss)
        assert abs(got[epoch]["train_loss"] - np.mean(losses)) < 1e-9 and abs(got[epoch]["tf_ratio"] - ratio) < 1e-12
    assert max(np.abs(m.p[k] - plain.p[k]).max() for k in m.p) < 1e-9


def test_training_is_taken_up_again(spark, tmp_path, monkeypatch):
    _, table = _training_pairs(spark)
    make = lambda: seq2seq.Seq2Seq(8, 8, hidden=3, layers=1, embedding=3, seed=2)
    run = lambda m, path, epochs=4: synchronous.fit_synchronous(m, table, str(tmp_path / path), epochs=epochs, size=16, rate=0.02, seed=3, shards=2, min_delta=10.0, patience=3)
    whole = make()
    want = run(whole, "a", 6)
    assert len(want) == 4  # the first epoch is the best, and after three more it stops
    publish, times = synchronous.Generations.publish, []

    def killed(self, row):
        times.append(row)
        if len(times) == 3:
            raise KeyboardInterrupt
        publish(self, row)

    monkeypatch.setattr(synchronous.Generations, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        run(make(), "b", 6)
    again = make()
    assert run(again, "b", 6) == want and [r[0] for r in times] == [0, 1, 2, 2, 3]
    assert all((again.p[k] == whole.p[k]).all() for k in whole.p)
    assert run(make(), "b", 6) == want  # nothing is left to do
    assert run(make(), "c", 0) == []


def test_batches_scored_together_are_those_scored_alone(spark):
    """Widths differ, a batch has one row and one no labels; and few bytes are still dealt to more than one task."""
    rng = np.random.default_rng(0)
    m = seq2seq.Seq2Seq(9, 9, hidden=3, layers=2, embedding=4)
    ids = lambda n: [int(x) for x in rng.integers(4, 9, n)]
    lists = [[([*ids(rng.integers(0, 9)), 2], [1, *ids(rng.integers(0, 12)), 2]) for _ in range(n)] for n in (4, 1, 3, 4)] + [[([2], [1]), ([4, 2], [1])]]
    batches = [(seq2seq.matrix([a for a, _ in x]), seq2seq.matrix([b for _, b in x])) for x in lists]
    for ratio in (0.0, 0.5, 1.0):
        got = m.score(batches, [np.random.default_rng(k).random(max(0, b.shape[1] - 2)) < ratio for k, (_, b) in enumerate(batches)])
        for k, ((a, b), (loss, greedy)) in enumerate(zip(batches, got)):
            logits = m.forward(a, b, ratio, np.random.default_rng(k))
            want = m.loss(logits, b[:, 1:])[0]
            assert (loss is None and want is None) or abs(loss - want) < 1e-12
            assert (greedy == logits.argmax(2)).all()
    rows = [(k, j, a, b) for k, (s, t) in enumerate(batches) for j, (a, b) in enumerate(zip(s.tolist(), t.tolist()))]
    scored = seq2seq.score_batches(spark.createDataFrame(rows, "batch_id long, pos_in_batch long, src array<int>, tgt array<int>"), m)
    assert scored.rdd.getNumPartitions() > 1 and sorted(r["batch_id"] for r in scored.collect()) == [0, 1, 2, 3, 4]


def test_a_shared_step_waits_for_nothing(spark, tmp_path):
    """Sixty steps of few rows: far less than a second each, which every exchange of a barrier stage takes. More steps than a part has."""
    _, table = _training_pairs(spark)
    m = seq2seq.Seq2Seq(8, 8, hidden=3, layers=1, embedding=3, seed=2)
    fit = lambda m, path, epochs: synchronous.fit_synchronous(m, table, str(tmp_path / path), epochs=epochs, size=1, rate=0.02, share=1.8, seed=3, shards=2)
    assert fit(seq2seq.Seq2Seq(8, 8, hidden=3, layers=1, embedding=3, seed=2), "warm", 0) == []
    began = time.time()
    assert fit(m, "g", 1)[0]["train_loss"] > 0 and time.time() - began < 45


@pytest.mark.parametrize("layers", [1, 2, 3])
def test_stacked_steps_are_those_by_layer(layers):
    """Loss and gradients, with rows of many widths, one without labels and one without a source; and a row takes part up to its last label."""
    rng = np.random.default_rng(layers)
    m = seq2seq.Seq2Seq(9, 8, hidden=3, layers=layers, embedding=4)
    ids = lambda n, most: [int(x) for x in rng.integers(4, most, n)]
    source, target = seq2seq.matrix([ids(k, 9) for k in (5, 1, 0, 7, 3)]), seq2seq.matrix([[1, *ids(k, 8), 2] for k in (4, 0, 9, 2, 2)])
    target[1] = 0
    for ratio in (1.0, 0.5, 0.0):
        loss, grads = m.step(source, target, ratio, np.random.default_rng(3))
        want, plain = m.step_by_layer(source, target, ratio, np.random.default_rng(3))
        assert abs(loss - want) < 1e-12 and max(np.abs(grads[k] - plain[k]).max() for k in plain) < 1e-12
    assert m.step(source, target * 0, 0.5, rng)[0] is None
    calls, step = [], seq2seq.Cell.step
    with pytest.MonkeyPatch.context() as x:
        x.setattr(seq2seq.Cell, "step", lambda self, z, *a: calls.append(len(z)) or step(self, z, *a))
        m.step(source, target, 1.0, rng)
    steps = sum(calls[layers * source.shape[1] :])
    assert len(calls) == layers * source.shape[1] + target.shape[1] - 1 + layers - 1 and steps < 5 * (target.shape[1] - 1)
