"""Words, pairs, training and encoding, by hand-made cases and properties."""

import hashlib
import json
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions.words import merged, segmented, unsegmented, words
from weft.operators import cache, counts, encode, shards, train
from weft.operators.encode import Model
from weft.plans import word_queries
from weft.sources import model_files
from weft.store import scratch, written

WORDS = [
    ("l'homme", ["l'homme"]), ("dogs' x", ["dogs'", "x"]), ("don''t", ["don'", "t"]), ("foo_bar", ["foo", "bar"]), ("l’homme", ["l", "homme"]),
    ("a-'b", ["a", "b"]), ("--a--b", ["a", "b"]), ("x-", ["x"]), ("'q'", ["q'"]), ("rock'n'roll", ["rock'n'roll"]), ("½ cup x²", ["½", "cup", "x²"]),
    ("été", ["e", "te"]), ("\U00010400\U00010401b", ["\U00010400\U00010401b"]), ("", []), (None, []),
]


def brute(freqs, n):
    """Count all pairs again for each merge."""
    split, rules = {w: [*w, "</w>"] for w in freqs}, []
    while len(rules) < n:
        c = Counter()
        for w, s in split.items():
            for p in zip(s, s[1:]):
                c[p] += freqs[w]
        if not c:
            break
        best = min(c, key=lambda p: (-c[p], p))
        rules.append((*best, c[best]))
        for s in split.values():
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == best:
                    s[i : i + 2] = [best[0] + best[1]]
                i += 1
    return rules


def test_words(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WORDS)], "i int, text string")
    got = {r["i"]: r["w"] for r in df.select("i", words(F.col("text")).alias("w")).collect()}
    assert [got[i] for i in range(len(WORDS))] == [w for _, w in WORDS]


@pytest.mark.parametrize("word, rule, want", [("aaa", ("a", "a"), ["aa", "a", "</w>"]), ("abab", ("a", "b"), ["ab", "ab", "</w>"]), ("ab", ("b", "</w>"), ["a", "b</w>"]), ("x", ("a", "b"), ["x", "</w>"])])
def test_merge(spark, word, rule, want):
    s = F.array(*[F.lit(c) for c in [*word, "</w>"]])
    assert spark.range(1).select(unsegmented(merged(segmented(s), F.lit(rule[0]), F.lit(rule[1]))).alias("x")).head()["x"] == want


def test_overlaps_count(spark):
    split = counts.with_symbols(spark.createDataFrame([("aaa", 1)], "word string, freq long"))
    assert {(r["l"], r["r"]): r["n"] for r in counts.pair_counts(split).collect()} == {("a", "a"): 2, ("a", "</w>"): 1}
    assert sorted(counts.pair_counts(split).collect()) == sorted(counts.pair_counts_by_window(split).collect())


def test_training_ends(spark):
    df = spark.createDataFrame([("ab", 1)], "word string, freq long")
    assert train.train_sharded(df, 10) == [("a", "b", 1), ("ab", "</w>", 1)] == train.learn(["ab"], [1], 10)
    assert train.train_sharded(df, 0) == [] == train.learn(["ab"], [1], 0)
    assert train.train_sharded(df.limit(0), 5) == [] == train.learn([], [], 5)


VOCABULARY = st.dictionaries(st.text("abc", min_size=1, max_size=7), st.integers(1, 5), min_size=1, max_size=12)


@settings(max_examples=300, deadline=None)
@given(VOCABULARY, st.integers(0, 25))
def test_learn_is_brute_force(freqs, n):
    assert train.learn(list(freqs), list(freqs.values()), n) == brute(freqs, n)


def test_tiers_agree(spark):
    text = "the cat sat on the mat that the other cats had sat on; rather than the hats"
    c = counts.word_counts(spark.createDataFrame([(text,)], "text string"))
    rows = [(r["l"], r["r"], r["n"]) for r in train.train_in_one_task(c, 30).orderBy("rank").collect()]
    assert train.train_sharded(c, 30) == rows == brute(Counter(text.replace(";", "").split()), 30)


@settings(max_examples=300, deadline=None)
@given(VOCABULARY, st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=8))
def test_deltas_are_differences_of_counts(freqs, rules):
    """Any rules, known pairs or not: the counts of all pairs before and after differ by the deltas."""

    def counted(shard):
        return Counter({(int(a), int(b)): int(n) for a, b, n in zip(*shard.pairs())})

    s = [x for w in freqs for x in [*("abc".index(c) for c in w), 3, shards.NONE]]
    shard = shards.Shard(np.array(s, np.int32).tobytes(), np.array(list(freqs.values()), np.int64).tobytes())
    plain, named = [[*("abc".index(c) for c in w), 3] for w in freqs], 4
    for a, b in rules:
        before = counted(shard)
        for l, r, n in shard.merge(a, b, named, deltas=True):
            for x in zip(l.tolist(), r.tolist(), n.tolist()):
                before[x[:2]] += x[2]
        after = counted(shard)
        assert {k: v for k, v in before.items() if v} == after
        for w in plain:
            i = 0
            while i + 1 < len(w):
                if w[i] == a and w[i + 1] == b:
                    w[i : i + 2] = [named]
                i += 1
        again = shards.Shard(*shard.row())
        assert again.s.tolist() == [x for w in plain for x in [*w, shards.NONE]] and counted(again) == after
        named += 1


@pytest.mark.parametrize("held, guessed, rewrite", [(200_000, 64, 128), (3, 64, 4), (1, 5, 1), (8, 1, 1000)])
def test_sharded_is_brute_force(spark, monkeypatch, held, guessed, rewrite):
    """However few counts the driver holds, pairs it tries, and rules it keeps before shards are written."""
    monkeypatch.setattr(train, "GUESSED", guessed)
    monkeypatch.setattr(train, "REWRITE", rewrite)
    freqs = {"abcabc": 9, "bcabca": 7, "aaaaaaa": 3, "aaaa": 5, "ab": 30, "bc": 29, "cab": 11, "abab": 2, "xyz": 4, "bcbcbc": 6, "ccc": 2, "aab": 5}
    c = spark.createDataFrame(list(freqs.items()), "word string, freq long")
    t = train.Trainer(c, held=held, shard=20)
    while t.step(14 - len(t.rules)) and len(t.rules) < 14:
        pass
    assert t.rules == brute(freqs, 14) and t.state.count() > 3

    class Every(set):
        def __contains__(self, x):
            return True

    # As if every symbol existed before it was made, which real words seldom do: pairs that the driver doesn't hold are asked for.
    t = train.Trainer(c, held=held, shard=20)
    t.exist = Every()
    while t.step(14 - len(t.rules)) and len(t.rules) < 14:
        pass
    assert t.rules == brute(freqs, 14)


@pytest.mark.parametrize("few", [0, 64])
def test_the_driver_gets_changes_of_its_own_pairs(spark, monkeypatch, few):
    """Of pairs that its table lacks, and of new pairs too rare for it, nothing; whether shards are added up by Spark or not."""
    monkeypatch.setattr(shards, "FEW", few)
    monkeypatch.setattr(train, "REWRITE", 2)
    freqs = {"abcabc": 9, "bcabca": 7, "aaaaaaa": 3, "aaaa": 5, "ab": 30, "bc": 29, "cab": 11, "abab": 2, "xyz": 4, "bcbcbc": 6, "ccc": 2, "aab": 5, "axbycz": 1}
    c = spark.createDataFrame(list(freqs.items()), "word string, freq long")
    t, whole, got = train.Trainer(c, held=4, shard=20), shards.deltas, []

    def noted(state, rules, steps, many, again=(), *a):
        changes = whole(state, rules, steps, many, again, *a)
        old = {k for k in range(len(t.names)) if k in t.exist}
        got.extend((p[:2] in t.count, p[0] in old and p[1] in old, p[2], t.floor, many) for k, x in enumerate(changes) if k not in again for p in x)
        return changes

    monkeypatch.setattr(shards, "deltas", noted)
    while len(t.rules) < 9 and t.step(9 - len(t.rules)):
        pass
    assert t.rules == brute(freqs, 9) and {x[4] for x in got} == {few == 0} and any(x[3] > 1 for x in got)
    assert all(held for held, old, n, floor, _ in got if old and floor > 1)
    assert few or all(n < 0 or n >= floor for _, _, n, floor, _ in got)


def test_sums_of_many_shards_are_spark_s_after_they_are_written_anew(spark, monkeypatch):
    """Many shards in few files are many still."""
    monkeypatch.setattr(shards, "FEW", 8)
    c = spark.range(400).select(F.hex(F.xxhash64("id")).alias("word"), F.lit(1).cast("long").alias("freq"))
    t = train.Trainer(c, shard=200)
    n = t.state.count()
    t._write(shards.applied(t.state.coalesce(2), []))
    assert t.state.count() == n > 8 and len(t.state.inputFiles()) <= 2 and t.many


def test_the_driver_holds_what_the_rules_left_need(spark, monkeypatch):
    """All pairs of the first count fit, but those made since don't; the rules stay the same."""
    monkeypatch.setattr(train, "NEEDED", 3)
    freqs = {"abcabc": 9, "bcabca": 7, "aaaaaaa": 3, "aaaa": 5, "ab": 30, "bc": 29, "cab": 11, "abab": 2, "xyz": 4, "bcbcbc": 6, "ccc": 2, "aab": 5}
    t = train.Trainer(spark.createDataFrame(list(freqs.items()), "word string, freq long"), shard=20)
    assert t.floor == 1
    sizes = []
    while len(t.rules) < 14 and t.step(min(3, 14 - len(t.rules))):
        sizes.append((t.floor, len(t.count)))
    assert t.rules == brute(freqs, 14) and max(f for f, _ in sizes) > 1 and min(n for _, n in sizes) < 8


def test_shards_stay_small_as_words_grow(spark):
    """Ten times as many words are more shards, not larger ones; so what a task holds stays the same."""
    sizes = []
    for n in (2_000, 20_000):
        c = spark.range(n).select(F.hex(F.xxhash64("id")).alias("word"), F.lit(1).cast("long").alias("freq"))
        t = train.Trainer(c, shard=5_000)
        sizes.append([r["n"] // 4 for r in t.state.select(F.length("symbols").alias("n")).collect()])
    assert max(sizes[0]) < 5_100 and max(sizes[1]) < 5_100 and len(sizes[1]) > 7 * len(sizes[0])


@settings(max_examples=200, deadline=None)
@given(VOCABULARY, st.integers(0, 15))
def test_sweep_is_rank_for_learned_rules(freqs, n):
    rules = [(a, b) for a, b, _ in train.learn(list(freqs), list(freqs.values()), n)]
    m = Model.learned(rules, [*"abc"])
    for w in freqs:
        s = [*w, "</w>"]
        for rule in rules:
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == rule:
                    s[i : i + 2] = [rule[0] + rule[1]]
                i += 1
        assert m.encode_word(w) == s and "".join(s) == w + "</w>"


def test_rank_and_sweep_differ_for_other_rules(spark):
    m = Model([("ab", "c"), ("a", "b")], [*"abc"])
    w = spark.createDataFrame([("abc",)], "word string")
    assert encode.encode_words(w, m).head()["tokens"] == ["abc", "</w>"]
    assert encode.sweep_words(w, m).head()["tokens"] == ["ab", "c", "</w>"]


def test_unknown_characters(spark):
    m = Model([], ["a"])
    w = spark.createDataFrame([("aça",), ("ç",)], "word string")
    for how in (encode.encode_words, encode.sweep_words):
        got = {r["word"]: r["tokens"] for r in how(w, m).collect()}
        assert got == {"aça": ["a", "<ukn>", "a", "</w>"], "ç": ["<ukn>", "</w>"]}
        got = {r["word"]: r["tokens"] for r in how(w, m, True).collect()}
        assert got == {"aça": ["a", "a", "</w>"], "ç": ["</w>"]}


def test_texts_keep_order_and_empty_rows(spark):
    m = Model([("a", "b")], [*"abc"])
    t = spark.createDataFrame([(1, "c ab c"), (2, ""), (3, "..."), (4, None), (5, "ab")], "doc_id long, text string")
    want = {1: ["c", "</w>", "ab", "</w>", "c", "</w>"], 2: [], 3: [], 4: [], 5: ["ab", "</w>"]}
    assert {r["doc_id"]: r["tokens"] for r in encode.encode_batch(t, m, workers=2).collect()} == want
    assert {r["doc_id"]: r["tokens"] for r in encode.encode_column(t, m).collect()} == want


def test_model_files(spark, tmp_path):
    m = Model([("a", "b"), ("b", "c"), ("a", "b")], ["a", "b", "ab"])
    assert m.ranks[("a", "b")] == 2
    path = str(tmp_path / "m.json")
    model_files.save_json(spark, m, path)
    assert list(json.load(open(path))) == ["word_break", "ukn_token", "rules", "tokens"]
    back = model_files.load_json(spark, path)
    assert (back.rules, back.tokens) == (m.rules, m.tokens)
    assert {(r["rank"], r["l"], r["r"]) for r in model_files.rules_table(spark, back).collect()} == {(2, "a", "b"), (1, "b", "c")}
    json.dump({"word_break": "#", "ukn_token": "", "rules": [["a", "b"]], "tokens": ["a"]}, open(path, "w"))
    old = model_files.load_json_legacy(spark, path, "?")
    assert (old.unknown, old.word_end) == ("?", "</w>")
    json.dump({"rules": [], "tokens": ["a"]}, open(path, "w"))
    for load in (model_files.load_json, model_files.load_json_legacy):
        with pytest.raises(ValueError):
            load(spark, path)


RULES = st.lists(st.tuples(st.sampled_from(["a", "b", "ab", "ba", "aa", "abab"]), st.sampled_from(["a", "b", "ab", "aa", "</w>"])), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=60), RULES)
def test_heap_merges_as_looking_at_all_pairs_does(word, rules):
    m = Model.learned(rules, ["a", "b"])
    s = [*word, "</w>"]
    assert m._merged(s.copy()) == m._merged_short(s.copy())


def test_a_very_long_word_takes_seconds():
    word = "abcde" * 40_000
    m = Model.learned([(a, b) for a, b, _ in train.learn([word[:50], "abc"], [1, 5], 30)], sorted(set(word)))
    began = time.time()
    tokens = m.encode_word(word)
    assert time.time() - began < 20 and "".join(tokens) == word + "</w>" and len(tokens) < len(word) / 4
    m.remembered(word)
    assert not m.memory


def plain_rules(freqs, n):
    """One merge after the other; for each pair the words that hold it."""
    split, c, holders, rules = {w: [*w, "</w>"] for w in freqs}, Counter(), defaultdict(set), []

    def add(w, sign):
        for p in zip(split[w], split[w][1:]):
            c[p] += sign * freqs[w]
            if not c[p]:
                del c[p]
            holders[p].add(w)

    for w in split:
        add(w, 1)
    while len(rules) < n and (top := max(c.values(), default=0)):
        best = min(p for p, x in c.items() if x == top)
        rules.append((*best, top))
        for w in list(holders.pop(best)):
            add(w, -1)
            s, i = split[w], 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == best:
                    s[i : i + 2] = [best[0] + best[1]]
                i += 1
            add(w, 1)
    return rules


def test_production_queries_are_plain_programs(spark, monkeypatch):
    """All 4,500 rules of all words of a table, by both tiers, and all its texts encoded by them, as tokens and as ids."""
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {i: regex.findall(r"[\p{L}\p{N}]+(?:['\-][\p{L}\p{N}]+)*'?", t) for i, t in docs.items()}
    freqs = Counter(w for ws in found.values() for w in ws)
    want = plain_rules(freqs, word_queries.PRODUCTION)
    assert len(want) == 4500 and want[:200] == brute(freqs, 200)
    got = word_queries.QUERIES["bpe_train_production"](spark, folder).orderBy("rank").collect()
    assert [(r["l"], r["r"], r["n"]) for r in got] == want and [r["rank"] for r in got] == list(range(4500))
    one = train.train_in_one_task(counts.word_counts(spark.read.parquet(f"{folder}/documents.parquet")), 4500)
    assert [(r["l"], r["r"], r["n"]) for r in one.orderBy("rank").collect()] == want

    # The other two learn the same rules; here they get those that were just compared.
    monkeypatch.setattr(train, "train", lambda words_, merges: spark.createDataFrame(got, train.RULES) if merges == 4500 else None)
    ranks, known = {(a, b): k for k, (a, b, _) in enumerate(want)}, {}
    for w in freqs:
        s = [*w, "</w>"]
        while (best := min(zip(s, s[1:]), key=lambda p: ranks.get(p, 9999))) in ranks if len(s) > 1 else False:
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == best:
                    s[i : i + 2] = [best[0] + best[1]]
                i += 1
        known[w] = s
    digest = lambda x: hashlib.md5(" ".join(map(str, x)).encode()).hexdigest()
    tokens = {i: [t for w in ws for t in known[w]] for i, ws in found.items()}
    texts = {r["doc_id"]: (r["n_tokens"], r["tokens_md5"]) for r in word_queries.QUERIES["encode_documents_production"](spark, folder).collect()}
    assert texts == {i: (len(t), digest(t)) for i, t in tokens.items()}
    number = {t: k + 4 for k, t in enumerate(sorted({c for w in freqs for c in w} | {"</w>"} | {a + b for a, b, _ in want}))}
    texts = {r["doc_id"]: (r["n_ids"], r["ids_md5"]) for r in word_queries.QUERIES["token_ids_production"](spark, folder).collect()}
    assert texts == {i: (len(t), digest(number[x] for x in t)) for i, t in tokens.items()}


def test_words_of_a_pair(spark):
    s = counts.with_symbols(spark.createDataFrame([("abab", 1), ("ba", 2), ("c", 1)], "word string, freq long"))
    asked = spark.createDataFrame([("a", "b"), ("x", "y"), ("a", "</w>")], "l string, r string")
    got = {tuple(r) for r in counts.words_with(counts.pair_postings(s), asked).collect()}
    assert got == {("a", "b", "abab"), ("a", "</w>", "ba")}


def test_groups_too_large_for_a_task(spark, monkeypatch):
    """A null group, too, is learned by the other tier."""
    rows = [(g, w, n) for g in (None, "x") for w, n in (("abab", 3), ("abc", 2), ("bca", 2))] + [("y", "ab", 1)]
    counted = spark.createDataFrame(rows, "lang string, word string, freq long")
    want = {(r["lang"], r["rank"], r["l"], r["r"], r["n"]) for r in train.train_by(counted, "lang", 4).collect()}
    monkeypatch.setattr(train, "KERNEL_PLACES", 5)
    assert {(r["lang"], r["rank"], r["l"], r["r"], r["n"]) for r in train.train_by(counted, "lang", 4).collect()} == want and any(x[0] is None for x in want)


def test_a_cache_encodes_only_what_it_lacks(spark, monkeypatch):
    m, path = Model([("a", "b"), ("ab", "c")], [*"abc"]), scratch(spark, "cache")
    words_of = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    asked, whole = [], cache.encode_words
    monkeypatch.setattr(cache, "encode_words", lambda new, *a: asked.append(sorted(r["word"] for r in new.collect())) or whole(new, *a))
    kept = cache.EncodingCache(spark, path, m, buckets=3)
    assert kept.rows().count() == 0
    assert kept.fill(words_of("abc", "ab", "ab", None), "one") == 2 and kept.fill(words_of("ab", "cab", "é"), "two") == 2
    kept = cache.EncodingCache(spark, path, m, buckets=3)
    assert kept.fill(words_of("abc", "cab")) == 0 and kept.fill(words_of()) == 0
    assert asked == [["ab", "abc"], ["cab", "é"]]
    want = {("abc", "one"): ["abc", "</w>"], ("ab", "one"): ["ab", "</w>"], ("cab", "two"): ["c", "ab", "</w>"], ("é", "two"): ["<ukn>", "</w>"]}
    assert {(r["word"], r["batch"]): r["tokens"] for r in kept.rows().collect()} == want

    class Killed(Exception):
        pass

    def killed(*args):
        raise Killed

    for step in ("publish", "write"):
        with monkeypatch.context() as x:
            x.setattr(kept.table, step, killed)
            with pytest.raises(Killed):
                kept.fill(words_of("new", "abc"), "three")
        assert kept.rows().count() == 4
    assert kept.fill(words_of("new", "abc"), "three") == 1 and kept.rows().count() == 5
    kept.compact()
    again = cache.EncodingCache(spark, path, m, buckets=3)
    assert {r["word"]: r["tokens"] for r in again.rows().collect()} == {w: t for (w, _), t in want.items()} | {"new": ["<ukn>", "<ukn>", "<ukn>", "</w>"]}
    assert again.fill(words_of("new", "abc")) == 0 and len(again.table.rows().inputFiles()) <= 3
    assert cache.EncodingCache(spark, path, Model(m.rules[:1], m.tokens), buckets=3).fill(words_of("abc")) == 1  # another model has its own
    texts = spark.createDataFrame([(1, "abc zz abc"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in again.encode(texts).collect()}
    assert got == {1: ["abc", "</w>", "<ukn>", "<ukn>", "</w>", "abc", "</w>"], 2: []}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weft_")]


def test_buckets_of_a_cache_stay_small_as_it_grows(spark, monkeypatch):
    """A first small batch doesn't fix the number of buckets; which batch encoded a word stays known."""
    monkeypatch.setattr(cache, "BUCKET_WORDS", 20)
    monkeypatch.setattr(cache, "LEAST_BUCKETS", 2)
    kept = cache.EncodingCache(spark, scratch(spark, "cache"), Model([], [*"0123456789w"]))
    of = lambda a, b: spark.range(a, b).select(F.concat(F.lit("w"), F.col("id")).alias("word"))
    assert kept.fill(of(0, 10), "one") == 10 and kept.fill(of(5, 200), "two") == 190 and kept.fill(of(0, 201), "three") == 1
    assert kept.table.meta()[-1]["buckets"] >= 10
    assert {(r["word"], r["batch"]) for r in kept.rows().collect()} == {(f"w{k}", "one" if k < 10 else "two" if k < 200 else "three") for k in range(201)} and kept.rows().count() == 201


def test_hot_words_are_not_shuffled(spark, monkeypatch):
    """A word in every place: none of its places are in the join by word, with adaptive execution off."""
    monkeypatch.setattr(encode, "HOT_PLACES", 100)
    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("the the the "), F.concat(F.lit("w"), F.col("id"))).alias("text"))
    texts = written(texts.unionByName(spark.createDataFrame([(100, "the"), (101, "")], "doc_id long, text string")), "texts")
    m = Model([("t", "h"), ("th", "e")], [*"thew0123456789"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = encode.encode_texts(texts, encode.encode_words(counts.distinct_words(texts), m))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["doc_id"]: r["tokens"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {r["doc_id"]: r["tokens"] for r in encode.encode_batch(texts, m).collect()} and len(got) == 62
    assert "BroadcastHashJoin" in plan and "NOT (word" in plan and "SortMergeJoin" in plan


def test_words_are_joined_once_a_chunk(spark, monkeypatch):
    """A word in every text is one row of the join for each chunk; texts of any layout, odd keys and missing encodings."""
    texts = written(spark.range(0, 3000, 1, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat the "), F.concat(F.lit("w"), F.col("id") % 7)).alias("text")), "texts")
    chunks = encode.in_chunks(texts)
    rows = chunks.select(F.size("vocabulary").alias("v"), F.size("at").alias("at")).agg(F.sum("v").alias("v"), F.sum("at").alias("at")).head()
    assert rows["at"] == 4 * 3000 and rows["v"] <= 9 * chunks.select("chunk").distinct().count() <= 9 * 3
    odd = spark.createDataFrame([("b", "x the"), (None, "the gone the"), ("a", None), ("c", "")], "name string, text string")
    encoded = spark.createDataFrame([("the", ["th", "e"]), ("x", [])], "word string, tokens array<string>")
    assert {r["name"]: r["tokens"] for r in encode.encode_texts(odd, encoded, "name").collect()} == {"b": ["th", "e"], None: ["th", "e", "th", "e"], "a": [], "c": []}


def test_encoding_holds_little(spark):
    """Batches of words and tokens are small, and remembered words share one string for each token."""
    m = encode.Model([("a", "b"), ("ab", "c")], ["a", "b", "c", "</w>", "ab", "abc"])
    first, second = m.remembered("abcx"), m.remembered("xabc")
    assert first == ["abc", "<ukn>", "</w>"] and second == ["<ukn>", "abc", "</w>"] and first[0] is second[1]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20)
    texts = spark.createDataFrame([(k, "abc ab ") for k in range(3)], "doc_id long, text string")
    assert {tuple(r["tokens"]) for r in encode.encode_column(texts, m).collect()} == {("abc", "</w>", "ab", "</w>")}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20


@pytest.mark.parametrize("name", ["encode_documents_cached", "encoding_cache", "token_ids_strict"])
def test_cache_and_strict_ids_learn_all_rules(spark, tmp_path, name):
    """With rules of production size, as a plain program and the query's SQL have it."""
    rng, langs = np.random.default_rng(3), ["en", "fr"]
    texts = {k: " ".join("".join(rng.choice([*"abc"], rng.integers(1, 9))) for _ in range(rng.integers(0, 60))) for k in range(8)}
    spark.createDataFrame([(k, t, langs[k % 2]) for k, t in texts.items()], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    freqs = Counter(w for t in texts.values() for w in t.split())
    rules = plain_rules(freqs, word_queries.PRODUCTION)
    assert len(rules) > 100
    m = Model([r[:2] for r in rules], [])
    m.known = {*"abc"}
    tokens = {k: [x for w in t.split() for x in m.encode_word(w)] for k, t in texts.items()}
    digest = lambda x: hashlib.md5(" ".join(map(str, x)).encode()).hexdigest()
    number = {t: k + 4 for k, t in enumerate(sorted({*"abc", "</w>"} | {a + b for a, b, _ in rules}))}
    want = {
        "encode_documents_cached": {(k, len(t), digest(t)) for k, t in tokens.items()},
        "token_ids_strict": {(k, len(t), digest(number[x] for x in t)) for k, t in tokens.items()},
        "encoding_cache": {(w, " ".join(m.encode_word(w)), min(langs[k % 2] for k, t in texts.items() if w in t.split())) for w in freqs},
    }[name]
    assert {tuple(r) for r in word_queries.QUERIES[name](spark, str(tmp_path)).collect()} == want
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert set(c.execute(word_queries.SQL[name]).fetchall()) == want
