"""Fill-in-middle against a plain version on whole strings, on frames of every size, and on odd rows."""

import hashlib
import random
import re

import pytest
import zstandard

from caselens.llm import fill_in_middle as fim
from caselens.llm.tables import set_worker_path

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    key = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(key[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts(seed, count):
    r = random.Random(seed)
    pieces = ["a", "né", "日本語", "<", "<P", "S>", "\U0001F600", " ", "  ", "\n", "\t", " ", "word", "x" * 40]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 15])
def test_frames_of_every_size(spark, size):
    set_worker_path(spark)
    docs = list(enumerate([*some_texts(size, 120), "", None, " ", "one", " \n ", "has <S> mark", "b" * 5000, "w " * 3000]))
    frames = fim.store(spark.createDataFrame(docs, "doc_id long, text string"), size)
    want = {i: plain_version(i, t) for i, t in docs}
    assert {w[1] for w in want.values()} == {"plain", "psm", "spm"}
    texts = {r.doc_id: r for r in fim.texts(fim.transform(frames)).collect()}
    for r in fim.digests(frames).collect():
        text = dict(docs)[r.doc_id] or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, texts[r.doc_id].output) == want[r.doc_id]
        assert texts[r.doc_id].restored == text
        assert r.output_sha256 == hashlib.sha256(want[r.doc_id][4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_cut_reads_one_frame():
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    frames, units, chars = fim.compressed(text, zstandard.ZstdCompressor(), 1000)
    assert len(frames) > 20
    for u in (1, 7, 2500, 4999, 5000):
        k, at, before = fim.cut_place([f if i == (k0 := next(i for i, n in enumerate(units) if n >= u)) else b"" for i, f in enumerate(frames)], units, chars, u)
        assert k == k0
        want = len(b" ".join(text.split(b" ")[:u]))
        assert before == want == sum(len(b"".join(fim.streamed([f]))) for f in frames[:k]) + at


def test_odd(spark):
    set_worker_path(spark)
    kind = "doc_id long, text string, n string, frames long, units double"
    rows = [(None, None, None, None, None), (None, "text of nobody", "x", 1, 0.5), (3, "same words", "x", 1, 0.5), (3, "same words", "x", 1, 0.5), (4, None, None, None, None)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n) for r in got) == [(False, 3, 2), (False, 3, 2), (False, 4, 0), (True, 0, 0), (True, 0, 3)]
    assert len({r for r in got if r.doc_id == 3}) == 1
    assert fim.fill_in_middle(spark.createDataFrame([], kind)).collect() == []
