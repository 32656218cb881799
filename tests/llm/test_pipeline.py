import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from weft.llm import decontaminate, quality
from weft.llm.labelled import folded

from .test_dedup import normalised, roots
from .test_models import edits
from .test_output import check_pieces, library

SF = "/root/testdata/sf0.001"
WHITE = r"[^\x20\x09-\x0D]+"


def good(docs, spark):
    """By the classifier's score, which has a test of its own."""
    own = folded(docs)
    model = quality.train(own, spark.read.parquet(f"{SF}/labels.parquet"))
    return {r["doc_id"] for r in quality.score(own, model).collect() if r["score"] >= 0.3}


def first_of_equals(texts):
    first = {}
    for i in sorted(texts):
        first.setdefault(normalised(texts[i]), i)
    return set(first.values())


def first_of_near(texts):
    order = sorted(texts)
    sets = []
    for i in order:
        w = re.findall(WHITE, "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i]))
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = roots(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    return {order[k] for k in set(root)}


def without_items(texts, items):
    items = [w for t in items if (w := decontaminate.words(t))]
    holds = lambda w: any(len(x) - int(len(x) * 0.2) <= len(w) and edits(x, w) <= int(len(x) * 0.2) for x in items)
    return {i for i, t in texts.items() if not holds(decontaminate.words(t))}


def test_every_stage_is_brute_force(spark):
    """Each stage on what the one before kept, computed anew by plain programs on whole texts."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    plain = [lambda: good(docs, spark), lambda: first_of_equals(texts), lambda: first_of_near(texts), lambda: without_items(texts, items)]
    sizes = [len(texts)]
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, plain):
        want = wanted()
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns
        docs = spark.createDataFrame(left.collect(), left.schema)
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        assert set(texts) == want, name
        sizes.append(len(texts))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ids = {i: np.array(library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in texts.items()}
    check_pieces(rows, ids, 4096)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in whole} == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in rows}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_rows(spark, odd, stage):
    left = stage(spark, odd, SF)
    assert left.columns == odd.columns and 0 < left.count() <= odd.count()
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_packing_stage_on_odd_rows(spark, odd):
    rows = corpus_pipeline.STAGES[-1][1](spark, odd, SF).collect()
    assert sum(r["start"] == 0 for r in rows) == odd.count() and all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), SF).count() == 0
