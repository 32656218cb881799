import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import BufferReader
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import chat, id_files, packing, simple8b, tokens, url_filter
from weft.store import scratch

from .conftest import ODD

FILES = {"word_bpe_49k.json": True, "byte_bpe_50k.json": False}


@cache
def library(name, special_as_text=False):
    t = Tokenizer.from_file(tokens.path_of(name))
    if special_as_text:
        t.encode_special_tokens = True
    return t


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]
WORDS = st.lists(st.sampled_from(["it's", "end.", "a", "ab", " ", "  ", "\n", "\n\n", ",\nThen", "x\ty", "(b)", "été,", "99.", "'s", "don't,", *SPECIAL]), max_size=12).map(" ".join)
TEXT = st.text(st.sampled_from("ab Z'.,\n\t 1é́日　\x1c\x85s½_|\x01"), max_size=30) | st.text(max_size=20) | WORDS


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT.filter(lambda t: t.encode("utf-8", "ignore").decode() == t), max_size=4))
def test_encoder_is_the_library(texts):
    for name, words in FILES.items():
        for as_text in (False, True):
            ids, many = tokens.encoder(tokens.path_of(name), words, as_text).encode(pa.array(texts, pa.string()))
            want = [e.ids for e in library(name, as_text).encode_batch(texts, add_special_tokens=False)]
            assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == want if texts else not len(ids)


def test_special_strings_are_special_tokens():
    for name, own in (("byte_bpe_50k.json", 50256), ("word_bpe_49k.json", 49407)):
        ids, _ = tokens.encoder(tokens.path_of(name), name.startswith("word")).encode(pa.array(["a <|endoftext|> b"]))
        assert own in ids.tolist()


@pytest.mark.parametrize("name", FILES)
def test_memory_stays_bounded(monkeypatch, name):
    monkeypatch.setattr(tokens, "REMEMBERED", 4000)
    e, want = tokens.Encoder(tokens.path_of(name), FILES[name]), library(name)
    for k in range(40):
        text = " ".join(f"abc{j} xyz{chr(97 + j % 26)}{k}.\nnext{j}" for j in range(k, k + 20))
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == want.encode(text, add_special_tokens=False).ids
        assert e.rest.size() < 4000 + 20 * 400


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400).map(float), max_size=60), st.integers(400, 500))
def test_first_fit(sizes, capacity):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    bins, want = [], []
    for s in sizes:
        k = next((i for i, b in enumerate(bins) if b + s <= capacity), len(bins))
        bins += [0] * (k == len(bins))
        bins[k] += s
        want.append(k)
    assert packing.first_fit_decreasing(sizes, capacity).tolist() == want


def check_pieces(rows, ids, length):
    """ids: of every document, which have distinct doc_ids."""
    at = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(own)
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : at[r["doc_id"]]].tobytes())
    assert at == {i: len(x) for i, x in ids.items()}
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= length
    return fill


def test_packing(spark, odd, docs_of):
    path = tokens.path_of("word_bpe_49k.json")
    assert packing.pack(docs_of([]), path).count() == 0
    assert packing.pack(odd, path).agg(F.sum("length")).head()[0] == sum(len(x.ids) + 1 for x in library("word_bpe_49k.json").encode_batch([t or "" for _, t in ODD], add_special_tokens=False))
    distinct = {i: t for i, t in ODD if i is not None}
    docs = docs_of(distinct.items())
    ids = {i: np.array(library("word_bpe_49k.json").encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in distinct.items()}
    packed = packing.pack(docs, path, 64, with_ids=True)
    fill = check_pieces(packed.collect(), ids, 64)
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed, 64).collect()}
    assert set(made) == set(fill)
    for r in packed.collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert bytes(r["ids"]) == own.tobytes() and made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == own.tolist()
    assert all(len(made[s]) == (n if n & (n - 1) == 0 else 64) for s, n in fill.items())


VALUES = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1), st.just(0)), max_size=3000)


@settings(max_examples=100, deadline=None)
@given(VALUES, st.integers(1, 400))
def test_simple8b(values, repeat):
    ids = np.array(values[:200] * repeat if repeat > 300 else values, np.uint64)
    words, escapes, blocks = simple8b.encode(ids)
    assert (simple8b.decode(words, escapes, blocks, len(ids)) == ids).all()


def test_file(monkeypatch):
    import io

    class Kept(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    monkeypatch.setattr(simple8b.Writer, "RUN", 2 * simple8b.BLOCK)
    rng, f = np.random.default_rng(0), Kept()
    w, parts = simple8b.Writer(f), []
    for k in range(40):
        x = rng.integers(0, [2, 60_000, 2**63][k % 3], rng.integers(0, 700)).astype(np.uint64)
        w.add(np.array([k]), np.array([k == 0]), np.array([len(x)]), x)
        parts.append(x)
    w.close()
    r, every = simple8b.Reader(type("F", (), {"size": lambda s: len(f.data), "read_at": lambda s, n, at: BufferReader(f.data).read_at(n, at)})()), np.concatenate(parts)
    assert r.many.tolist() == [len(x) for x in parts] and r.doc_ids.tolist() == list(range(40)) and r.null.tolist() == [True] + [False] * 39 and r.n_ids == len(every)
    for a, b in ((0, len(every)), (5, 5), (1000, 1030), (1024, 2048), (len(every) - 3, len(every))):
        assert (r.ids(a, b) == every[a:b]).all()
    with pytest.raises(ValueError):
        simple8b.Reader(type("F", (), {"size": lambda s: 100, "read_at": lambda s, n, at: b"x" * n})())


def test_millions_of_empty_texts_take_little_memory(monkeypatch):
    """Each is the end id alone."""
    import tracemalloc

    class Nothing:
        def write(self, x):
            pass

        def close(self):
            pass

    tracemalloc.start()
    w = simple8b.Writer(Nothing())
    for k in range(40):
        w.add(np.arange(100_000) + 100_000 * k, np.zeros(100_000, bool), np.ones(100_000, np.int64), np.zeros(100_000, np.uint32))
    held = tracemalloc.get_traced_memory()[0]
    w.close()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w.docs == w.ids == 4_000_000 and held < 100e6 and most < 300e6


def test_files_end_by_documents_too(spark, docs_of, monkeypatch):
    monkeypatch.setattr(id_files, "FILE_DOCS", 3)
    monkeypatch.setattr(id_files, "READ_DOCS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        docs = docs_of([(k, "a b" * (k % 3)) for k in range(20)])
        files = id_files.write(docs, "file:" + scratch(spark, "ids").removeprefix("file:"), tokens.path_of("byte_bpe_50k.json"))
        rows = id_files.read_back(files).orderBy("doc_id").collect()
        assert files.count() >= 5 and [r["doc_id"] for r in rows] == list(range(20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(20)]


def test_id_files(spark, odd, docs_of, monkeypatch):
    path = tokens.path_of("byte_bpe_50k.json")
    assert id_files.read_back(id_files.write(docs_of([]), scratch(spark, "f"), path)).count() == 0
    rows = id_files.read_back(id_files.write(odd, scratch(spark, "f"), path)).orderBy("start", "n_tokens").collect()
    hashed = {(r["doc_id"], r["text"]): r["h"] for r in odd.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, hashed[x]))
    at = 0
    for r, (i, t) in zip(rows, order, strict=True):
        ids = np.array(library("byte_bpe_50k.json").encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


LONG = "## \\# </turn>\n: " * 20_000
CHATS = [
    (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, "assistant", r"\### Assistant: </turn> ok"), (2, 1, "assistant", r"x\ </turn>"), (2, 2, "us:er\\", "### "),
    (3, None, None, None), (3, 0, "assistant", None), (None, 0, "user", "</turn>\n"), (4, 0, "assistant", "a\\"), (4, 1, "assistant", "###"), (4, 2, "user", "\n"), (5, 0, "</turn>", "#### </turn></turn>\n\n"),
    (6, 0, "user", LONG), (6, 1, "assistant", LONG[1:]), (6, 2, "assistant", "x" * 300_000),
]


def chats(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "y") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, n_turns long, formatted string")


def source(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda y: (y[1] is not None, y[1] or 0, y[2] or "", y[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_chat(spark):
    import hashlib

    out = chat.format_conversations(chats(spark, CHATS))
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    for c, turns in source(CHATS).items():
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        own = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), sha(own))
    for r in out.collect():
        assert all(r["formatted"][m["start"] : m["start"] + m["length"] + 7].endswith("</turn>") for m in r["loss"])
        assert r["formatted"].count("</turn>") == r["n_turns"] == len(re.findall("### ", r["formatted"]))
    assert chat.format_conversations(chats(spark, [])).count() == 0


def test_chat_round_trip_of_any_text(spark):
    rng = np.random.default_rng(0)
    parts = ["\\", "</turn>", "### ", "#", "\n", ":", "a", "é", "<", "/turn>", " "]
    rows = [(k, t, ["user", "assistant", ":\\ </turn>"][t], "".join(rng.choice(parts, rng.integers(0, 9)))) for k in range(300) for t in range(3)]
    out = chat.format_conversations(chats(spark, rows)).select("conv_id", chat.parsed(F.col("formatted")).alias("t"))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in out.collect()}
    assert got == source(rows)


@pytest.mark.parametrize("hot", [10_000, 2])
def test_url_filter(spark, monkeypatch, hot):
    monkeypatch.setattr(url_filter, "HOT_ROWS", hot)
    monkeypatch.setattr(url_filter, "HOT_KEYS", 8)
    deep = "http://a.b.com/" + "/".join(f"s{k}" for k in range(1000))
    caps = spark.createDataFrame(
        [(1, "http://a.b.com/x/y?q", 5, 0), (2, "http://a.b.com/x/y?q", 1, 0), (3, "https://u@B.com:80/", 5, 0), (4, None, 5, 0), (5, "nonsense", 5, 0), (6, "http://b.com", None, 0), (7, "http://a.b.com/x", 200, 0), (7, "http://a.b.com/x", 200, 0), (8, deep, 5, 0)],
        "id long, url string, day int, key int",
    )
    entries = spark.createDataFrame([("b.com", 2, "block"), (deep[7:-4], 1, "block"), (deep[7:-5], 1, "allow"), ("b.com", 2, "block"), ("a.b.com/x", 5, "allow"), ("a.b.com/x", 150, "allow"), ("a.b.com/x", 150, "block"), ("com", 0, "allow"), (None, 1, "block"), ("b.com", None, "block")], "key string, day int, action string")
    got = url_filter.filter_captures(caps, entries).select("id", "key", "since", "blocked").collect()
    want = [(1, "a.b.com/x", 5, False), (2, "com", 0, False), (3, "b.com", 2, True), (4, None, None, False), (5, None, None, False), (6, None, None, False)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [*want, *[(7, "a.b.com/x", 150, True)] * 2, (8, deep[7:-5], 1, False)]))
    assert not any(r["blocked"] for r in url_filter.filter_captures(caps, entries.limit(0)).collect())
    assert url_filter.filter_captures(caps.limit(0), entries).count() == 0
