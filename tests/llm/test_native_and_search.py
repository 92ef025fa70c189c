import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import license_scan, quality_rules, topk_search


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_edges(spark):
    r = random.Random(5)
    texts = [None, "", " \n ", "a b c d e f g h " * 40, "x\ny\nx\n \nx", "&*# $%", "é" * 300, " a b c", "one " * 7, "one " * 9]
    texts += [" ".join(r.choices("abc", k=r.randint(1, 60))) + "\n" * r.randint(0, 2) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "a"), (1, "")], "doc_id long, text string").withColumns({"kept": F.lit("x"), "n_words": F.lit("y")})
    got = quality_rules.quality_rules(df).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        want = plain_counts(row.text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, repr(row.text)
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (row.kept and row.base_failed)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_estimation_finds_the_accuracies():
    r = random.Random(2)
    n, good = len(quality_rules.RULES), [0.97] * len(quality_rules.RULES)
    counts: dict = {}
    for _ in range(20000):
        bad = r.random() < 0.2
        p = tuple(0 if r.random() < 0.1 else (-1 if r.random() < (0.6 if bad else 0.03) else 1) for _ in range(n))
        counts[p] = counts.get(p, 0) + 1
    share, right = quality_rules.estimate(sorted(counts.items()))
    assert share == pytest.approx(0.8, abs=0.03)
    assert np.allclose([a for a, _ in right], good, atol=0.02) and np.allclose([b for _, b in right], 0.6, atol=0.05)


def test_license_edges(spark):
    fill = " ".join(f"w{i}" for i in range(50))
    long = {label: t for t, label in license_scan.TEMPLATES}
    cut = long["mit-text"].split()
    texts = [None, "", "...", "MIT License", f"{fill} Released under the MIT License. {fill}", "gnu general public. LICENSE! cc by cc-by", f"{fill} {long['mit-text'].lower()} {fill}", f"all rights {fill} reserved", "apache apache license", "permission granted free"]
    texts += [" ".join(cut[:150]), " ".join(cut[:90]), f"{long['bsd-2-clause']} {fill} {long['gpl-notice']}", "released under license, the MIT one", f"{fill} " * 400 + long["apache-2.0-notice"], "gnu gnu general public license apache license"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "cc by"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"labels": F.lit(1), "word": F.lit(2)})
    got = sorted((tuple(r) for r in license_scan.summary(*license_scan.license_scan(df)).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and by[0] == (0, 0, 0, None, None, "", "", 0.0)
    assert by[3] == (3, 2, 1, 0, 0, "mit", "mit", 1.0)
    assert by[4][2:7] == (1, 53, 53, "mit", "mit,mit-notice")
    assert by[5][2:6] == (3, 0, 6, "cc-by,gpl")
    assert by[6][5:7] == ("", "mit-text") and by[6][7] == 1.0
    assert by[7][6] == "" and by[8][2:4] == (1, 1) and by[9][6] == ""
    assert by[10][6] == "mit-text" and 0.8 <= by[10][7] < 1 and by[11][6] == "" and by[12][6] == "bsd-2-clause,gpl,gpl-notice" and by[13][6] == ""
    assert by[14][6] == "apache,apache-2.0,apache-2.0-notice" and by[14][3] == 400 * 50 + 3 and by[15][2:5] == (2, 1, 5)
    connection = duckdb.connect()
    documents = df.select("doc_id", "text").where("doc_id <> 3").toPandas()  # noqa: F841
    want = connection.sql(license_scan.oracle()).fetchall()
    assert sorted(want, key=str) == sorted([r for r in got if r[0] not in (3, None)], key=str)
    assert license_scan.summary(*license_scan.license_scan(df.limit(0))).count() == 0


def plain_top(rows, k):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    out = []
    for q, qv in {(i, tuple(v)): (i, v) for i, v in ok if i % 50 == 0}.values():
        best = sorted(((-int(qv @ v), i) for i, v in ok if i != q and len(v) == len(qv)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.01, 300.0])
def test_search_equals_brute_force(spark, monkeypatch, scale):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6) * scale).round(3 if scale > 0.1 else 1).tolist()) for i in range(260)]
    rows += [(300, [0.0] * 6), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] + [0.0] * 5), (304, []), (350, [1.0, 2.0]), (351, [3.0, 1.0]), (400, [float("inf")] * 6)] + [(i, rows[0][1]) for i in range(500, 530)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    index, queries = topk_search.usable(df, "vec_id", "embedding", 256), topk_search.usable(df.where("vec_id % 50 = 0"), "vec_id", "embedding", 256)
    got = sorted(tuple(x) for x in topk_search.search(index, queries, block=70, query_block=3).collect())
    assert got == plain_top(rows, 5)


def test_search_without_rows(spark):
    df = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
