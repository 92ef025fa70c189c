import random
import re

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import ngram_join


def plain(docs, threshold=0.8):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids, links, root = sorted(sets), {}, {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in ids:
        links[a] = 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and x >= threshold * (len(sets[a]) + len(sets[b]) - x):
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    return {d: (top(d), links[d]) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(2, 5)))
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 120)))) for i in range(60)]
    for i in range(60, 160):
        w = r.choice(docs[:20])[1].split()
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = word()
        docs.append((i, ", ".join(w)))
    return docs + [(200, None), (201, ""), (202, "One two"), (203, "one TWO!"), (204, "one two three")]


def test_equals_brute_force(spark, monkeypatch):
    docs = corpus(1)
    want = plain(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(df).collect()}
    assert got == want
    assert sum(n for _, n in want.values()) > 100


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    docs = corpus(2)[:110]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(df).collect()}
    assert got == plain(docs)


def test_several_texts_under_one_id(spark):
    """One text stands for the id from the sketch to the verification: its neighbour is linked, whichever it is."""
    r = random.Random(9)
    for _ in range(4):
        a, b = ([f"{r.choice('abc')}{r.randrange(999)}" for _ in range(60)] for _ in range(2))
        rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1])), (3, " ".join(b[:-1]))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {x.doc_id: x for x in ngram_join.ngram_join(df).collect()}
        assert sorted(x.n_links for x in got.values()) == [0, 1, 1] and got[1].n_links == 1


def test_recall_of_near_copies(spark):
    """Of pairs at the threshold or above, found by banding and verified: all but a share of 1e-5."""
    r = random.Random(3)
    docs = []
    for k in range(150):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 300))]
        docs.append((2 * k, " ".join(w)))
        for _ in range(max(1, len(w) // 60)):
            w[r.randrange(len(w))] = "other"
        docs.append((2 * k + 1, " ".join(w)))
    want, df = plain(docs), spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.ngram_join(df).collect()}
    linked = {d for d in want if want[d][1]}
    assert len(linked) > 100 and sum(got[d] == want[d] for d in linked) >= 0.9 * len(linked)


def test_long_and_clashing(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "a")], "doc_id long, text string").withColumns({"doc": F.lit("x"), "same": F.lit(1), "digest": F.lit(2)})
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.ngram_join(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(None, "a b", 1), (3, "a b c d e f", 1), (3, "a b c d e f", 1), (4, None, 1)], "doc_id long, text string, class long")
    assert sorted(tuple(r) for r in ngram_join.ngram_join(df).collect()) == [(3, 3, 3, 0), (4, 4, 4, 0)]
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_spanning():
    assert dict(ngram_join.spanning(np.array([1, 3, 0]), np.array([2, 4, 1]), 6)) == {1: 0, 2: 0, 4: 3}
