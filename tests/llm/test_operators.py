"""Each training-data operator against a brute-force version or held-out labels, and on nulls, empty, repeated and clashing input."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import decontamination, html_extract, language_id, lattice, mixing, ngram_join, quality, spotsigs, toxicity, url_filter
from caselens.llm.html_pages import labelled_page
from caselens.llm.queries import ORACLES, QUERIES
from caselens.llm.tables import set_worker_path

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"


def rows(*texts):
    return [(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    set_worker_path(spark)
    data = rows("", None, " \t\n ", "one", "Same words here and there", "same words here and there", "x " * 30_000, "é" * 5000, "!!! ???")
    data += [data[4], (None, None, None, None, None, None, None), (None, "text of nobody", "en", None, 3, 0.0, None)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    set_worker_path(spark)
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = lowered(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets, best = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        before = dict(best)
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
        if before == best:
            return best, {i: len(s) for i, s in sets.items()}


def variants(seed, groups=12, size=6):
    """Texts of many lengths with near copies around the threshold, and a passage that all share."""
    r, out = random.Random(seed), []
    shared = " ".join(f"common{k}" for k in range(14))
    for g in range(groups):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice((3, 5, 8, 12, 30, 60, 150)))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
            out.append(" ".join(w) + (" " + shared if g % 2 else ""))
    return out


def test_ngram_join_brute(spark):
    set_worker_path(spark)
    texts = dict(enumerate(variants(1) + ["", None, "a b", "A  b", "a b"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, sizes = brute_components(texts)
    got = {r.doc_id: r for r in ngram_join.ngram_components(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == sorted(set(want.values()))


def test_ngram_join_small_blocks(spark, monkeypatch):
    """Later rounds find what the star and the first block leave."""
    set_worker_path(spark)
    monkeypatch.setattr(ngram_join, "BLOCK", 1)
    texts = dict(enumerate(variants(2, groups=4)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()} == brute_components(texts)[0]


def hubs(seed, groups):
    """Per group A, B, C: B of 9 to 20 shingles, A with one end of it edited and C with the other, so far that A and C aren't similar."""
    r, out = random.Random(seed), []
    for _ in range(groups):
        n = r.randint(9, 20)
        e = 1 if n < 18 else 2
        base = [f"w{r.randint(0, 10**9)}" for _ in range(n + 4)]
        other = [f"e{r.randint(0, 10**9)}" for _ in range(2 * e)]
        three = [other[:e] + base[e:], base, base[:-e] + other[e:]]
        r.shuffle(three)
        out.append([" ".join(w) for w in three])
    return out


def test_ngram_join_hubs(spark):
    """A signature of two classes is compared although the star has tried the greater one against another head."""
    set_worker_path(spark)
    texts, want = {}, {}
    for seed in range(40):
        for group in hubs(seed, 50):
            part = dict(enumerate(group, len(texts)))
            texts.update(part)
            want.update(brute_components(part)[0])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()}
    assert len(got) == len(want) and {i: c for i, c in got.items() if want[i] != c} == {}


def test_ngram_join_odd(odd, empty):
    got = ngram_join.ngram_components(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id is null").count() == 2
    assert ngram_join.ngram_components(empty).count() == 0


def test_signatures_are_shared():
    """Any two sets within the bound share a signature, whatever is taken as common."""
    r = np.random.default_rng(0)
    table = ngram_join.bands(4000, 80)
    from caselens.llm import words as W

    def sigs(items, common):
        v = np.array(sorted(items), dtype=np.uint64)
        return set(ngram_join.set_signatures(W.mix(v) >> np.uint64(32), W.mix(v + np.uint64(9)), ~np.isin(v, common), table, 80).tolist())

    for n in (1, 4, 5, 7, 9, 13, 20, 40, 90, 300):
        for _ in range(15):
            a = set(r.integers(0, 1 << 60, n).tolist())
            b = set(a)
            while True:
                c = set(b)
                c.discard(r.choice(sorted(c))) if r.random() < 0.5 and len(c) > 1 else c.add(int(r.integers(0, 1 << 60)))
                if 100 * len(a & c) < 80 * len(a | c):
                    break
                b = c
            common = np.array(sorted(a)[:: r.integers(1, 4)], dtype=np.uint64)
            assert sigs(a, common) & sigs(b, common), n


def test_spotsigs_brute(spark):
    set_worker_path(spark)
    texts = [(1, "The cat sat on the mat and the dog ran of to it away"), (2, None), (700, "É à la carte of the day"), (5_000_000, "und der Hund lief"), (700, "second of seven")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = spotsigs.fingerprint_edits(docs).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got if r.doc_id != 700}
    cut = lambda a, b: a[: len(a) - len(a) // 2] + b[: len(a) // 2]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[2].edited_sha256 == sha("") and by[2].n_chars == 0 and by[2].fingerprint == ""
    assert by[1].edited_sha256 == sha(cut(texts[0][1], "und der Hund lief"))
    assert by[5_000_000].edited_sha256 in {sha(cut("und der Hund lief", t)) for _, t in texts if t}


def test_spotsigs_chains(spark):
    text = F.lit("x The cat of the big mat; is gone")
    a, b, c = spark.range(1).select(spotsigs.signatures(text), spotsigs.signatures(F.lit("the cat big")), spotsigs.signatures(F.lit("no anchors here at"))).first()
    assert len(a) == 3 and set(b) < set(a)  # "the: cat big", "of the: big mat", "is: gone"
    assert len(c) == 1  # "no: anchors here"; "at" has nothing behind it


def test_spotsigs_pairs(spark):
    r = random.Random(3)
    sets = [sorted(r.sample(range(60), r.randint(1, 30))) for _ in range(25)]
    sets += [s[:-1] + [99] for s in sets if len(s) > 8] + [[], sets[0]]
    got = spotsigs.similar_pairs(spark.createDataFrame(list(enumerate(sets)), "id long, sigs array<int>"), 0.7)
    near = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and near(sets[i], sets[j]) >= 0.7}
    assert {(x.a, x.b) for x in got.collect()} == want and want


def test_spotsigs_odd(odd, empty):
    got = spotsigs.fingerprint_edits(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    assert spotsigs.fingerprint_edits(empty).count() == 0


def held_out_auc(got, labels, column):
    both = got.join(labels, "doc_id").where("held_out").select("score", "predicted", column).toPandas()
    rank, y = both["score"].rank(), both[column] == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()), both


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, SF.replace("0.01", "0.1"))
    auc, both = held_out_auc(got, labels, "toxic")
    assert auc > 0.85 and both.loc[both["toxic"] == 0, "predicted"].mean() < 0.05
    assert got.count() == 10_000 and got.where("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.5)").isEmpty()


def test_toxicity_prior(spark):
    """The scores keep to the labels' share of toxic rows, also where more rows of either class are labelled than are fitted."""
    set_worker_path(spark)
    big = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id")
    often = lambda df: df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("doc_id", F.col("doc_id") * 20 + F.col("copy")).drop("copy")
    share = labels.agg(F.avg("toxic")).first()[0]
    once, many = (toxicity.scores(docs, m).toPandas()["score"].mean() for m in (toxicity.fit_rows(docs, labels), toxicity.fit_rows(often(docs), often(labels))))
    assert abs(once - share) < 0.04 and abs(many - share) < 0.04, (share, once, many)


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, None), (5, 0, 2), (None, 1, 1), (4, 0, 0)], "doc_id long, toxic int, score int")
    got = toxicity.judge(odd, labels)
    assert got.count() == odd.count() and got.where("score is null").isEmpty()
    assert toxicity.judge(empty, labels).count() == 0 and toxicity.judge(odd, labels.limit(0)).count() == odd.count()
    kept = toxicity.civil(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count() and toxicity.civil(empty, labels).isEmpty()


def test_quality_held_out(spark):
    auc, both = held_out_auc(QUERIES["op4_quality"](spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    assert auc > 0.95 and both.loc[both["quality"] == 1, "predicted"].mean() > 0.95


def test_quality_trees():
    """The flat walk gives what following each tree row by row gives."""
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.grow(x, y, trees=15)
    p = forest.probability(x)
    for i in range(0, 400, 37):
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if x[i, forest.feature[node]] <= forest.bound[node] else forest.right[node]
            total += forest.value[node]
        assert math.isclose(p[i], 1 / (1 + math.exp(-total)))
    assert ((p >= 0.5) == y).mean() > 0.95


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    assert quality.judge(odd, labels).where("score is not null").count() == odd.count()
    assert quality.judge(empty, labels).count() == 0


def test_url_rules(spark):
    set_worker_path(spark)
    urls = ["http://a.net/x", "http://example.net/en/1", "https://A.Example.NET/en/", "http://example.net/fr", "http://x.example.com/de/a?b", "http://q.org/fr/", "http://q.org/frx", "http://net?x", None, "no url", "http://mynet/", "", "http://b.org#/fr/"]
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = [r for r in url_filter.judge(pages).orderBy("page_id").collect()]
    assert [r.rule for r in got] == ["net/", "example.net/en/", "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None, None]
    assert (got[2].host, got[2].path) == ("a.example.net", "/en/") and (got[7].host, got[7].path) == ("net", "") and got[8].host == "" and got[12].path == ""
    assert all(r.verdict == ("block" if r.rule in ("net/", "example.com/de/") else "allow") for r in got if r.rule) and got[9].verdict == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_ranks(spark):
    """Ranks equal those of a dense computation; who links to a blocked host is blocked, who is linked from a trusted one isn't."""
    set_worker_path(spark)
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [(1, "http://bad.net/", link("far.com")), (2, "http://friend.com/", link("bad.net", "bad.net")), (3, "http://ok.org/fr/", link("fine.com")), (4, "http://fine.com/a", ""), (5, "http://fine.com/b", "<a href=/x>")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"} and got[4].trust > 0
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 1.0), ("c", "d", 2.0)]
    names = "abcd"
    m, seed = np.zeros((4, 4)), np.array([0.75, 0.0, 0.25, 0.0])
    for s, d, w in edges:
        m[names.index(d), names.index(s)] = w
    m /= np.where(m.sum(axis=0) > 0, m.sum(axis=0), 1)
    x = seed
    for _ in range(6):
        x = 0.85 * m @ x + 0.15 * seed
    got = url_filter.personalised_rank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 3.0), ("c", 1.0)], "host string, weight double"), rounds=6)
    assert all(math.isclose(r.score, x[names.index(r.host)], abs_tol=1e-9) for r in got.collect())


def test_lattice_brute():
    """The forward recursion is the sum over all segmentations; expected counts sum to what they spell."""
    pieces = lattice.vocabulary()
    logs = dict(zip(pieces.keys.tolist(), pieces.logs.tolist(), strict=False))

    def key(text):
        h = np.uint64(0)
        for c in text:
            h = lattice._step(h, np.uint64(ord(c)))
        return int(h)

    def brute(text):
        total = -math.inf
        for cuts in range(1 << (len(text) - 1)):
            ends = [i + 1 for i in range(len(text) - 1) if cuts >> i & 1] + [len(text)]
            x, at = 0.0, 0
            for e in ends:
                part = text[at:e]
                x += logs.get(key(part), pieces.logs[-1] - math.log(256) + math.log(1) if len(part) > 1 else -math.inf) if key(part) in logs else (pieces.logs[-1] - math.log(256)) * len(part.encode()) if len(part) == 1 else -math.inf
                at = e
            total = np.logaddexp(total, x)
        return total

    for word in ("the", "there", "ünter", "zq", "日x"):
        points = np.array([[0x2581, *map(ord, word)]], dtype=np.uint64)
        got, counts = lattice.log_probabilities(points, pieces, np.ones(1))
        assert math.isclose(got[0], brute("▁" + word), rel_tol=1e-9), word
        assert counts.sum() > 0


def test_lattice_long_words(monkeypatch):
    """Stretches give what the whole lattice gives, in probability and in expected counts; a word of a megabyte takes seconds."""
    pieces = lattice.vocabulary()
    r = random.Random(3)
    for word in ("internationalisation" * 9, "".join(r.choice("abcdeéß日 ".strip()) for _ in range(300)), "x" * 130):
        points = np.array([[0x2581, *map(ord, word)]], dtype=np.uint64)
        want, counts = lattice.log_probabilities(points, pieces, np.array([2.5]))
        for stretch in (7, 64, 1 << 16):
            monkeypatch.setattr(lattice, "STRETCH", stretch)
            got, found = lattice.long_word(points[0], pieces, 2.5)
            assert math.isclose(got, want[0], rel_tol=1e-9) and math.isclose(lattice.long_word(points[0], pieces)[0], got, rel_tol=1e-12)
            assert np.allclose(found, counts, atol=1e-6)
    points = np.array([0x2581, *map(ord, "".join(r.choice("ACDEGT") for _ in range(1 << 20)))], dtype=np.uint64)
    started = time.time()
    assert lattice.long_word(points, pieces)[0] < 0
    assert time.time() - started < 60


def test_lattice_held_out(spark):
    """Every round of expectation maximisation makes held-out texts likelier."""
    set_worker_path(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    totals = [lattice.score(docs, rounds=k).where("held_out").agg(F.sum("score")).first()[0] for k in (0, 1, 2)]
    assert totals[0] < totals[1] < totals[2]


def test_word_counts_hand_over(spark, monkeypatch):
    """Counts don't depend on how many words a task holds, nor on the size of a word."""
    set_worker_path(spark)
    docs = spark.createDataFrame([(i, f"a b b Word{i % 7} {'z' * (3_000_000 if i == 5 else 3)}") for i in range(40)], "doc_id long, text string")
    whole = {(r.word, r.c, r.n) for r in lattice.word_counts(docs, F.col("doc_id") % 2 == 0).collect()}
    monkeypatch.setattr(lattice, "HELD", 3)
    assert {(r.word, r.c, r.n) for r in lattice.word_counts(docs, F.col("doc_id") % 2 == 0).collect()} == whole
    assert ("b", 40, 80) in whole and ("z" * 3_000_000, 0, 1) in whole and ("zzz", 20, 39) in whole


def test_lattice_base(spark):
    got = QUERIES["op6_lm_scoring"](spark, SF).collect()
    texts = {r.doc_id: lowered(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    c = Counter()
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        w = [*texts[r.doc_id], None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9) and r.score < 0


def test_lattice_odd(odd, empty):
    got = lattice.score(odd).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert lattice.score(empty).count() == 0


def test_mixing(spark):
    set_worker_path(spark)
    data = [(i, "w " * (5 + i % 7), "big" if i % 3 else f"s{i % 4}", 9) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, mix_pass long")
    got = mixing.mix(docs, target=0.95, most=3.0, blocks=64).toPandas()
    tokens, n = Counter(), Counter()
    for _, t, s, _ in data:
        tokens[s] += len(t.split())
    total = sum(tokens.values())
    w = got.groupby("source")["mix_weight"].first()
    names = sorted(tokens)
    a = mixing.find_exponent(np.array([tokens[s] for s in names], dtype=float), total, 0.95, 3.0)
    powers = {s: (tokens[s] / total) ** a for s in names}
    assert all(math.isclose(w[s], powers[s] / sum(powers.values()), rel_tol=1e-9) for s in names)
    for s, part in got.groupby("source"):
        used, budget = part["mix_tokens"].sum(), total * w[s]
        assert budget - tokens[s] / 8 <= used <= budget + 1e-6
        n[s] = part["mix_pass"].max()
        counts = part.groupby("doc_id")["mix_pass"].nunique()
        assert counts.min() >= math.floor(budget / tokens[s]) or math.floor(budget / tokens[s]) == 0
        assert (part.groupby(["doc_id", "mix_pass"]).size() == 1).all()
    assert got["mix_order"].between(0, 1, inclusive="left").all() and max(n.values()) <= 3


def test_mixing_exponent():
    t = np.array([900.0, 90.0, 10.0])
    a = mixing.find_exponent(t, 1000, 0.9, 1e9)
    assert math.isclose(mixing.entropy(mixing.weights(t / 1000, a)), 0.9 * math.log(3), rel_tol=1e-6)
    b = mixing.find_exponent(t, 1000, 0.9, 5.0)
    assert math.isclose((1000 * mixing.weights(t / 1000, b) / t).max(), 5.0, rel_tol=1e-6) and b > a
    assert mixing.find_exponent(np.array([5.0]), 5, 0.9, 2) == 1.0


def test_mixing_odd(odd, empty):
    got = mixing.mix(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() > 0
    assert mixing.mix(empty).count() == 0


def edits(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_brute(spark):
    set_worker_path(spark)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(r.randint(6, 40)))) for k in range(12)]
    for k in range(12, 24):  # phrases that repeat, as in multiple choice
        phrase = " ".join(word() for _ in range(3))
        items.append((k, " ".join(f"{phrase} {word()}" for _ in range(r.randint(3, 6)))))
    items += [(90, None), (91, ""), (92, "tiny")]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(20)] + [(50, "a tiny thing"), (51, "tinyx"), (52, None), (53, "")]
    docs.append((54, "pre fix words zbg dhab hgzec cehb gbg dhahb hghec hgg gbg dhahb hhec ehd gbg dhahb hzhec ecf post fix words"))
    items.append((93, "gbg dhahb hghec cechb gbg dhahb hghec hgg gbg dhahb hghec ehd gbg dhahb hghec ecf"))
    for i in range(150):
        text = list(r.choice(items[:24])[1])
        for _ in range(r.randint(0, int(0.1 * len(text)))):
            k = r.randrange(len(text))
            text[k : k + 1] = r.choice(["", "z", text[k] + "y"])
        docs.append((100 + i, f"{word()}  {word()}, {''.join(text).upper()}! {word()} {word()}"))
    schema = "id long, text string"
    got = decontamination.matches(spark.createDataFrame(docs, schema).toDF("doc_id", "text"), spark.createDataFrame(items, schema).toDF("item_id", "text")).collect()
    want = {}
    for i, t in docs:
        for k, item in items:
            m, n = decontamination.normal(item), decontamination.normal(t)
            if m and n and (d := edits(m, n)) <= (int(decontamination.RATE * len(m)) if len(m) >= decontamination.SHORT else 0) and (len(m) >= decontamination.SHORT or f" {m} " in f" {n} "):
                want[i, k] = d
    assert {(x.doc_id, x.item_id): x.distance for x in got} == want and len(want) > 15
    assert want[54, 93] == 6
    assert all(0 <= x.start < x.end <= len(dict(docs)[x.doc_id]) for x in got)
    text = "İİİ one İx two İ three"  # three of its letters are two code points in lower case
    assert decontamination._place(text, len(decontamination.normal(text)), len("three")) == (text.index("three"), len(text))


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "same words here and there"), (None, "x"), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.matches(odd, items).collect()} == {4, 5}
    kept = decontamination.uncontaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    named = odd.withColumn("doc_id", F.lit(None).cast("long"))
    assert decontamination.uncontaminated(named, items).count() == odd.count() - 3
    assert decontamination.matches(empty, items).count() == 0 and decontamination.matches(odd, items.limit(0)).count() == 0


FOREIGN = [
    (
        "<!doctype html><html><head><title>t</title></head><body class=home><div class='topnav'><a href=/>Home</a> <a href=/a>About us</a></div><main role=main><h1>How rivers move</h1>"
        "<p>Rivers carry sand, silt and stones from the hills to the sea, and drop them where the water slows.</p><figure><img src=a.png><figcaption>A bend of the river in spring.</figcaption></figure>"
        "<h2>Floods</h2><p>After heavy rain the water spreads over the plain. It leaves a thin layer of mud&nbsp;&mdash; good soil.</p></main>"
        "<footer><p>Copyright 2020. All rights reserved.</p></footer></body></html>",
        "How rivers move\n\nRivers carry sand, silt and stones from the hills to the sea, and drop them where the water slows.\n\nA bend of the river in spring.\n\nFloods\n\n"
        "After heavy rain the water spreads over the plain. It leaves a thin layer of mud \u2014 good soil.",
    ),
    (
        "<html><body><header class='site-header'><p>Daily News</p></header><div id=content><article class=post><h1>Bread</h1><ol><li>Mix flour and water.</li><li>Wait for one hour, then bake.</li></ol>"
        "<table><tr><td>Flour</td><td>500 g</td></tr></table></article></div><div class=sidebar><h3>Most read</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div>"
        "<section id=comments><div class=comment><p>Nice recipe, thank you!</p></div></section><div class=cookie-notice>We use cookies <button>Accept all</button></div></body></html>",
        "Bread\n\nMix flour and water.\n\nWait for one hour, then bake.\n\nFlour\n\n500 g",
    ),
]


def test_html_held_out():
    field = html_extract.fitted(400, 4)
    right = total = 0
    for seed in range(9000, 9080):
        seen, truth = html_extract.labelled(seed)
        right += sum(a == b for a, b in zip(field.decode(seen), truth, strict=True))
        total += len(truth)
    assert right / total > 0.97


def test_html_viterbi_brute():
    field = html_extract.train([html_extract.labelled(k) for k in range(30)], 2)
    for seed in range(60, 75):
        seen = html_extract.features(html_extract.leaf_blocks(labelled_page(seed)[0]))[:9]
        s = field.scores(seen)
        value = lambda y, s=s: sum(x for x, b in zip(s, y, strict=True) if b) + sum(field.move[a][b] for a, b in zip(y, y[1:], strict=False))
        paths = list(itertools.product((0, 1), repeat=len(s)))
        assert math.isclose(value(field.decode(seen)), max(map(value, paths)), abs_tol=1e-9)
        z = sum(math.exp(value(y)) for y in paths)
        one = field.marginals(seen)[0]
        assert all(math.isclose(p, sum(math.exp(value(y)) for y in paths if y[k]) / z, abs_tol=1e-9) for k, p in enumerate(one))


def test_html_blocks(spark):
    page = "<head><title>t</title></head><body><article><h1>A &amp;lt; B</h1><p>one\n two<br>three<p><b>four</b> <a href=x>five<script>var a='</p>'</script></article><!-- no --><p>1 < 2"
    assert [b.text for b in html_extract.leaf_blocks(page)] == ["A &lt; B", "one two three", "four five", "1 < 2"]
    set_worker_path(spark)
    pages = spark.createDataFrame([(1, "u", None, "z"), (2, None, "", "z"), (None, "u", "<div>", "z"), (3, "u", page, "z"), (3, "u", page, "z")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages, html_extract.fitted(200, 3)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and got[0].text == ""
    assert {r.text for r in got if r.page_id == 3} == {"A &lt; B\n\none two three\n\nfour five"}
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_pages(spark):
    got = QUERIES["op9_html_extraction"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(got) == 250
    for r in got:
        whole = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h\d|li|ul|ol|div|blockquote|pre|table|tr|td|section|figure|figcaption)\b[^>]*>", whole)
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_html_unclosed():
    """Elements without an end hide no more than their own words; formulas stay in their sentence; quotes count after = only."""
    texts = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    for tag in ("button", "option", "object", "svg", "canvas", "iframe", "noscript", "template"):
        assert texts(f"<{tag}>go<article><p>one</p><p>two</p></article><p>x <{tag}>hidden</{tag}> y") == ["one", "two", "x y"]
    assert texts("<p>a<script>if (x < 1) '<p>'") == ["a"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> be") == ["Let x=1 be"]
    assert texts("<p title=it's class=x>one</p><p title='a>b' id=\"c>d\">two</p>") == ["one", "two"]
    assert texts("<p>five <svg><svg></svg><text>no</text></svg>six<style>p{}</style>ty") == ["five sixty"]
    assert texts("<a href=" + "x='" * 50_000) == ["<a href=" + "x='" * 50_000]


def test_html_foreign_pages():
    """Pages written by hand in layouts that the training pages don't have."""
    field = html_extract.fitted()
    for page, want in FOREIGN:
        assert html_extract.article(page, field) == want


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op10_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()


def test_language_brute(spark):
    """Scores equal a plain naive Bayes over the same hashed n-grams."""
    set_worker_path(spark)
    data = [(0, "der hund", "de"), (1, "the dog", "en"), (2, "the cat 1", "en")]
    langs, matrix = language_id.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), buckets=64)
    assert langs == ["de", "en"]
    from caselens.llm import words as W
    import pyarrow as pa

    grams = {}
    for i, t, _ in data:
        b, row, _ = language_id.ngrams(*W.text_bytes(pa.array([t])), 64, language_id.ORDERS)
        assert len(b) == sum(any(c.isalpha() for c in t[k : k + n]) for n in language_id.ORDERS for k in range(len(t) - n + 1))
        grams[i] = Counter(b.tolist())
    for j, lang in enumerate(langs):
        c = sum((grams[i] for i, _, x in data if x == lang), Counter())
        want = [math.log((c[k] + 0.5) / (sum(c.values()) + 32)) for k in range(64)]
        assert np.allclose(matrix[:-1, j], want, atol=1e-4)


def test_language_odd(odd, empty):
    got = {r.doc_id: r for r in language_id.detect(odd).collect()}
    assert got[1].lang_pred == got[0].lang_pred == got[8].lang_pred == "und" and got[3].lang_pred == "en"
    assert language_id.detect(empty).count() == 0
    kept = language_id.known_language(odd)
    assert kept.columns == odd.columns and kept.where("text = 'text of nobody'").count() == 1
    assert kept.where("text is null or text in ('', '!!! ???')").isEmpty() and language_id.known_language(empty).isEmpty()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for view in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{SF.replace('0.01', '0.001')}/{view}.parquet'")
    got = QUERIES[name](spark, SF.replace("0.01", "0.001"))
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(con.sql(f"SELECT {', '.join(sorted(want.columns))} FROM ({ORACLES[name]})").fetchall())


def test_pipeline(spark):
    """Stages keep the columns of documents; the mixture holds only rows that every stage's operator keeps."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert list(out.columns)[: len(docs.columns)] == docs.columns and len(out) > 500
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = [decontamination.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: decontamination.normal(texts[i]) for i in set(out["doc_id"])}
    assert not any(b in t for b in bench for t in kept.values())
    sets = {i: frozenset(shingle_set(texts[i])) for i in kept}
    assert len(set(sets.values())) == len(sets)
    # no two of the kept are near copies
    assert brute_components({i: texts[i] for i in kept})[0] == {i: i for i in kept}
