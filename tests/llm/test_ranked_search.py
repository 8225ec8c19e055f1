"""Ranked search against scoring of every document, on texts of many lengths, ties and small segments, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from caselens.llm import ranked_search
from caselens.llm.tables import set_worker_path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = set()
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n) // length
            score = 0
            for t in terms(text):
                if t in b:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m))
            if score > 0:
                scores.append((-score, i))
        out |= {(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def corpus(seed, count):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rare = [f"Ñr{i}é" for i in range(400)] + [f"日{i}" for i in range(40)]
    texts = []
    for _ in range(count):
        if texts and r.random() < 0.2:
            texts.append(r.choice(texts))
        else:
            texts.append(" ".join(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(r.choice((1, 5, 20, 80, 300)))))
    return texts


@pytest.mark.parametrize(("seed", "segment", "ahead"), [(1, 1 << 23, 32), (2, 2000, 3), (3, 300, 1)])
def test_brute(spark, monkeypatch, seed, segment, ahead):
    set_worker_path(spark)
    monkeypatch.setattr(ranked_search, "SEGMENT", segment)
    monkeypatch.setattr(ranked_search, "AHEAD", ahead)
    monkeypatch.setattr(ranked_search, "FIRST", 3)
    docs = list(enumerate(corpus(seed, 300) + ["", None, "!!! ...", "C1 c1 C1"]))
    texts = [t for t in corpus(seed, 300) if t]
    items = list(enumerate([*random.Random(seed).sample(texts, 20), "c1 c1 c1 C2", "unknown words", "", None, "c0"]))
    random.Random(seed).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranked_search.search_all(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == brute(docs, items)
    assert len(got) == len(set(got))


def test_blocks_of_queries(spark, monkeypatch):
    set_worker_path(spark)
    monkeypatch.setattr(ranked_search, "PAIRS", 40)
    docs, items = list(enumerate(corpus(5, 80))), list(enumerate(t for t in corpus(6, 15)))
    got = ranked_search.search_all(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3).collect()
    assert {tuple(r) for r in got} == brute(docs, items, 3)


def test_range_maxima():
    r = np.random.default_rng(0)
    lists = [np.sort(r.choice(500, n, replace=False)) for n in (1, 2, 7, 64, 300)]
    block = ranked_search.Block([], np.arange(5), np.ones(5, np.int64), [], [], 500, 50_000)
    lengths = r.integers(1, 300, 500).astype(np.int32)
    sizes = np.array([len(x) for x in lists], np.int32)
    p = ranked_search.Postings(np.arange(5), sizes, np.concatenate(lists).astype(np.int32), r.integers(1, 9, sizes.sum()).astype(np.int32), lengths, block)
    for a, b in zip(p.starts, p.ends, strict=True):
        for _ in range(50):
            x, y = sorted(r.integers(a, b + 1, 2))
            if x < y:
                assert p.impacts[p.maxima(np.array([[x]]), np.array([[y]]))[0, 0]] == p.impacts[x:y].max()


def test_pruning_leaves_documents_unopened():
    """A document that stands out is found without scoring the others."""
    ids = np.arange(1000)
    doc = np.repeat(ids, 3)
    words = np.stack([np.full(1000, 1), np.arange(1000) % 7 + 10, np.arange(1000) + 100], axis=1).ravel()
    batch = ranked_search.segment(0, ids, words, doc)
    part = {c: batch.column(c)[0].values.to_numpy() for c in batch.schema.names[2:]}
    block = ranked_search.Block([1], np.array([1, 12, 600]), np.array([1, 1900, 6500]), [np.arange(3)], [np.ones(3, np.int64)], 1000, 3000)
    p = ranked_search.Postings(part["terms"], part["sizes"], part["docs"], part["tfs"], part["lengths"], block)
    opened = []
    real = p.maxima
    p.maxima = lambda a, b: opened.append(len(a)) or real(a, b)
    found, _ = ranked_search.best_documents(p, part["doc_ids"], np.arange(3), block.weights, 1, 0)
    assert found.tolist() == [500]
    assert sum(opened) < 20


def test_odd(spark):
    set_worker_path(spark)
    kind = "doc_id long, text string, term string, score long, segment double"
    rows = [(None, None, None, None, None), (None, "same words", "x", 1, 0.5), (3, "same words", "x", 1, 0.5), (3, "same words", "x", 1, 0.5), (4, None, None, None, None), (5, "other", None, None, None)]
    items = spark.createDataFrame([(1, "same"), (1, "same"), (None, "same"), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame(rows, kind)
    got = ranked_search.search_all(docs, items).collect()
    assert {(r.item_id, r["rank"], r.doc_id) for r in got} == {(1, 1, 3), (1, 2, 3)}
    assert ranked_search.search_all(spark.createDataFrame([], kind), items).collect() == []
    assert ranked_search.search_all(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []
