import random

import pytest

from orrery.llm import line_dedup


def plain(docs, min_words):
    """Every run of every length against every earlier place."""
    lines = {d: [x for x in t.split("\n") if x.split()] for d, t in docs}
    places = [(d, i) for d in sorted(lines) for i in range(len(lines[d]))]
    gone = {d: set() for d in lines}
    for a in places:
        for b in places:
            if b >= a:
                break
            (da, i), (db, j), n, words = a, b, 0, 0
            while i + n < len(lines[da]) and j + n < len(lines[db]) and lines[da][i + n].strip() == lines[db][j + n].strip():
                words += len(lines[da][i + n].split())
                n += 1
            if words >= min_words:
                gone[da] |= set(range(i, i + n))
    return {d: [x for i, x in enumerate(lines[d]) if i not in gone[d]] for d in lines}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choices("abcdefgh", k=r.choice([1, 2, 4, 9]))) for _ in range(12)]
    docs = []
    for d in range(30):
        text = [r.choice(pool) for _ in range(r.randint(0, 14))]
        if d and r.random() < 0.5:
            text[1:1] = r.choice(docs)[1].split("\n")[: r.randint(1, 9)]
        docs.append((d, "\n".join(text)))
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8).collect()
    want = plain(docs, 8)
    assert {row.doc_id: [x for x in row.text.split("\n") if x.split()] for row in got} == want
    assert sum(row["__removed"] for row in got) > 0


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None, 5), (2, "", 5), (None, long, 5), (3, long, 5), (4, f"own line\n\n{long}", 5), (5, f"{long}\n", 5), (5, f"{long}\n", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, span long")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r["__removed"], r.span) for r in line_dedup.line_dedup(df).collect() if r.doc_id != 1)
    assert got == [(-1, long, 0, 5), (2, "", 0, 5), (3, long, 0, 5), (4, "own line\n", 1, 5), (5, "", 1, 5), (5, "", 1, 5)]
    assert line_dedup.line_dedup(df.where("doc_id = 1")).first().text is None
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
