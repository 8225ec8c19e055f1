"""Substring dedup against a dictionary of all windows, on texts that share, repeat and interleave passages, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from caselens.llm import substring_dedup
from caselens.llm import words as W
from caselens.llm.tables import set_worker_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, width=20):
    first, words = {}, {i: WORD.findall(t or "") for i, t in texts.items()}
    for i in sorted(words):
        for a in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][a : a + width]), (i, a))
    out = {}
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] != (i, a):
                gone.update(range(a, a + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def passages(seed, count=60):
    """Copies, edits, shared passages of 15 to 60 words, repeats inside a text, and runs of one word."""
    r = random.Random(seed)
    shared = [[f"p{k}w{r.randint(0, 40)}" for _ in range(r.randint(15, 60))] for k in range(6)]
    texts = []
    for _ in range(count):
        kind = r.random()
        if kind < 0.25 and texts:
            w = texts[r.randrange(len(texts))].split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
        elif kind < 0.35:
            w = [r.choice("ab") for _ in range(r.randint(1, 80))]
        else:
            w = []
            for _ in range(r.randint(0, 6)):
                p = r.choice(shared)
                w += p[r.randint(0, 10) :] if r.random() < 0.5 else [f"u{r.randint(0, 10**6)}" for _ in range(r.randint(1, 30))]
        texts.append((" " if r.random() < 0.9 else " \n").join(w))
    return texts


def results(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize(("seed", "piece"), [(1, 1 << 20), (2, 1 << 20), (3, 300)])
def test_brute(spark, monkeypatch, seed, piece):
    set_worker_path(spark)
    texts = dict(enumerate([*passages(seed), "", None, "one", "same same " * 300, "Word word " * 12, "word Word " * 12]))
    order = list(texts)
    random.Random(seed).shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(4)
    assert results(substring_dedup.remove_repeats(docs)) == brute(texts)


def test_pieces_hold_every_window(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 200)
    text = " ".join(f"w{i}" * (40 if 100 < i < 130 else 1) for i in range(400)).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    found = {}
    for _, part, start, stop, _, number in substring_dedup.pieces(data, at, 20):
        words = [part[a:b].tobytes() for a, b in zip(start, stop, strict=True)]
        for k in range(len(words) - 19):
            assert number + k not in found
            found[number + k] = words[k : k + 20]
    words = text.split()
    assert found == {k: words[k : k + 20] for k in range(len(words) - 19)}


def test_judge_by_pieces(monkeypatch):
    words = [f"w{i}" for i in range(500)]
    whole = substring_dedup.judge(" ".join(words).encode(), [(10, 5), (12, 30), (300, 1)], [(10, 5), (299, 2)], 20)
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    assert substring_dedup.judge(" ".join(words).encode(), [(10, 5), (12, 30), (300, 1)], [(10, 5), (299, 2)], 20) == whole
    gone = {k for a, n in ((10, 5), (12, 30), (300, 1)) for k in range(a, a + n + 19)}
    assert whole[:3] == (500, len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())


def test_paths_hold_every_window_once():
    text = " ".join(passages(5)).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    start, stop, row = W.word_spans(data, at)
    p = substring_dedup.paths_of(data, start, stop, row, 1, 20, 6, 0)
    assert np.array_equal(np.concatenate([np.arange(a, a + n) for a, n in zip(p["start"], p["size"], strict=True)]), np.arange(len(start) - 19))
    # equal windows have equal minimizers
    seen = {}
    for mini, a, n in zip(p["mini"], p["start"], p["size"], strict=True):
        for k in range(a, a + n):
            assert seen.setdefault(text[start[k] : stop[k + 19]].split().__repr__(), mini) == mini


def test_collisions_are_found(spark):
    """A span whose words are not those of its source is seen when both are read at their coordinates."""
    set_worker_path(spark)
    texts = dict(enumerate(passages(7, 12)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    base = docs.selectExpr("doc_id", "text", "hash(text) AS tie")
    ties = {r.doc_id: r.tie for r in base.collect()}
    rows = [(4, ties[4], 0, 1, 3, ties[3], 0)]
    wrong = spark.createDataFrame(rows, "doc_id long, tie int, start int, windows long, src_doc_id long, src_tie int, src_start int")
    _, judged = substring_dedup.cut(base, wrong, 20)
    assert substring_dedup.differing(wrong, judged).count() == 1


def test_odd(spark):
    set_worker_path(spark)
    long = " ".join(f"w{i}" for i in range(30))
    kind = "doc_id long, text string, tie string, path long, mini double"
    rows = [(None, None, None, None, None), (None, long, "x", 1, 0.5), (3, long, "x", 1, 0.5), (3, long, "x", 1, 0.5), (4, None, None, None, None), (5, long + " end", None, None, None)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, kind)).collect())
    assert got == [(-1, 0, 0), (-1, 30, 0), (3, 30, 0), (3, 30, 0), (4, 0, 0), (5, 31, 30)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], kind)).collect() == []
