import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, language_id, lattice_lm, toxicity

tokenizers = pytest.importorskip("public_tokenizers")

ODD = [None, "", " \n\t ", "...", "é", "Hello  WORLD", "x" * 5000, "a b " * 3000, "naïve Café été", "İstanbul ΣΑΣ K", "á Å ﬁ", "\x1c\x1da b", "<|startoftext|>x <|EndOfText|> <|endoftext|>", "日本語 テスト 👍🏽", "it's WE'LL 12345", "tab\tnew\nline sep"]


def table(spark, texts, **extra):
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null id"), (3, texts[3]), (3, texts[3])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "word": F.lit(1)})


def test_bpe_equals_the_library(spark, monkeypatch):
    path = tokenizers.path("word_bpe_49k.json")
    t = bpe.tokenizer(path)
    r = random.Random(1)
    chars = "abcAB12'.,é́Kßσς  \x1c\x85 \n\t<|>"
    texts = ODD + ["".join(r.choices(chars, k=r.randint(1, 60))) for _ in range(150)]
    monkeypatch.setattr(bpe, "least_count", lambda table, most: 4)
    got = bpe.encode(table(spark, texts), path).collect()
    assert len(got) == len(texts) + 3
    for row in got:
        text = "null id" if row.doc_id is None else texts[row.doc_id] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(ids), repr(text)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), repr(text)
        assert row.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), repr(text)
    assert bpe.encode(table(spark, texts).limit(0), path).count() == 0


def every_segmentation(model, word):
    text = "▁" + word

    def walk(i):
        if i == len(text):
            return 1.0
        total = sum(math.exp(model.pieces[text[i:j]]) * walk(j) for j in range(i + 1, len(text) + 1) if text[i:j] in model.pieces)
        if text[i] not in model.pieces:
            total += math.exp(sum(model.bytes[b] for b in text[i].encode())) * walk(i + 1)
        return total

    return math.log(walk(0))


def test_lattice_sums_all_segmentations():
    model = lattice_lm.lattice(tokenizers.path("piece_bpe_32k.model"), {300: 5, 400: 7}, 3)
    for word in ("the", "ononing", "é", "a👍b", "\x01x"):
        assert model.word(word) == pytest.approx(every_segmentation(model, word), abs=1e-9)
    total = sum(math.exp(p) for p in [*model.pieces.values(), *model.bytes]) + math.exp(model.end)
    assert total == pytest.approx(1, abs=1e-6)


def test_lm_base_score_and_edges(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "least_count", lambda table: 3)
    texts = ODD + ["a b a", "the the cat", "zebra"]
    df = table(spark, texts)
    model = tokenizers.path("piece_bpe_32k.model")
    got = lattice_lm.lm_score(df, F.coalesce(F.col("doc_id"), F.lit(0)) % 4 != 1, model).collect()
    docs = [(r.doc_id, r.text or "") for r in df.collect()]
    counts: dict = {}
    for d, t in docs:
        if (d or 0) % 4 != 1:
            for w in [*t.encode().lower().split(), "end"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((d if d is not None else -1, len(w := [*t.encode().lower().split(), "end"]), sum(x in counts for x in w), round(sum(math.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for d, t in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    none = lattice_lm.lm_score(df, F.lit(False), model).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert lattice_lm.lm_score(df.limit(0), F.lit(True), model).count() == 0


def plain_ppm(counts, ctx, sym):
    """Code length by the definition: escape from order 3 down to a uniform code."""
    p = 1 / 256
    for k in (0, 1, 2, 3):
        c = counts[k].get(ctx[3 - k :], {})
        if c:
            n, d = sum(c.values()), len(c)
            p = c[sym] / (n + d) if sym in c else d / (n + d) * p
    return -math.log2(p)


@pytest.mark.parametrize("dense", [language_id.DENSE, 20_000, 0])
def test_ppm_code_lengths(spark, monkeypatch, dense):
    """Every context counts, whether it has a row of the table or not."""
    monkeypatch.setattr(language_id.Trees.__init__, "__defaults__", (dense,))
    train = [(1, "The cat sat on the mat 12", "en"), (2, "le chat été là; le chat", "fr"), (3, "the dog & the cat\n", "en")]
    lab = spark.createDataFrame(train, "doc_id long, text string, lang string")
    trees = language_id.train(lab, text="text", lang="lang", key="doc_id", max_train_docs=10, max_train_bytes=10_000)
    assert trees.langs == ["en", "fr"]
    counts = {lang: [{} for _ in range(4)] for lang in trees.langs}
    for _, text, lang in train:
        s = list(b"   " + text.encode())
        for i in range(3, len(s)):
            for k in range(4):
                c = counts[lang][k].setdefault(tuple(s[i - k : i]), {})
                c[s[i]] = c.get(s[i], 0) + 1
    texts = ["The chat zz", "", "été 12!?", "x" * 50, "日本 the cat sat\x00\x01", "le dog & été"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    got = language_id.lengths(data, offsets, trees)
    for t, row in zip(texts, got, strict=True):
        s = list(b"   " + t.encode())
        for lang, bits in zip(trees.langs, row, strict=True):
            assert bits == pytest.approx(sum(plain_ppm(counts[lang], tuple(s[i - 3 : i]), s[i]) for i in range(3, len(s))), rel=1e-5)


def test_predictions_are_the_shortest_codes(spark):
    r = random.Random(6)
    kinds = {"x": "abcde ", "y": "abfgh ", "z": "cdefgé "}
    rows = [(k, "".join(r.choices(kinds[g], k=r.randint(1, 90))), g) for k in range(240) for g in [r.choice("xyz")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = df.where("doc_id % 3 > 0")
    got = {x.doc_id: x for x in language_id.language_id(df, lab).collect()}
    counts = {g: [{} for _ in range(4)] for g in "xyz"}
    for d, t, g in rows:
        s = list(b"   " + t.encode())
        for i in range(3, len(s)) if d % 3 else ():
            for k in range(4):
                c = counts[g][k].setdefault(tuple(s[i - k : i]), {})
                c[s[i]] = c.get(s[i], 0) + 1
    for d, t, _ in rows:
        s = list(b"   " + t.encode())
        bits = {g: sum(plain_ppm(counts[g], tuple(s[i - 3 : i]), s[i]) for i in range(3, len(s))) for g in "xyz"}
        best = min("xyz", key=bits.get)
        if not t.strip():
            assert got[d].lang_pred == "und" and got[d].score == 0
        elif sorted(bits.values())[1] - bits[best] > 0.01:
            assert got[d].lang_pred == best
            over = [(b - bits[best]) * min(1, language_id.EVIDENCE / len(t.encode())) for b in bits.values()]
            assert got[d].score == pytest.approx(1 / sum(2.0 ** -min(x, 200) for x in over), rel=1e-3)


def test_too_many_labels(spark):
    lab = spark.range(600).selectExpr("id as doc_id", "'a b' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="distinct labels"):
        language_id.language_id(lab, lab)


def test_language_edges(spark):
    lab = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    df = spark.createDataFrame([(1, "the cat", 1), (2, "la table", 1), (3, None, 1), (4, "", 1), (5, "123 !?", 1), (None, "the", 1), (6, "é", 1)], "doc_id long, text string, lang_pred int")
    got = {r.doc_id: r for r in language_id.language_id(df, lab).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"] and len(got) == 7
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].score == 0
    assert {r.lang_pred for r in language_id.language_id(df, lab.limit(0)).collect()} == {"und"}


def test_toxicity_learns_and_edges(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcde", k=4))
    docs = []
    for k in range(300):
        words = [word() for _ in range(r.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["vile", "Scum!", "foul"]))
        docs.append((k, " ".join(words), int(toxic)))
    df = spark.createDataFrame([d[:2] for d in docs] + [(900, None), (901, ""), (None, "vile"), (5, "again")], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(k, y) for k, _, y in docs if k % 3] + [(None, 1), (7, None)], "doc_id long, label int")
    got = toxicity.toxicity(df, labels).collect()
    held = [(x.score >= 0.5) == bool(x.doc_id % 4 == 0) for x in got if x.doc_id is not None and x.doc_id < 300 and x.doc_id % 3 == 0 and x.doc_id != 5]
    assert np.mean(held) > 0.97 and len(got) == 304
    empty = {x.doc_id: x.score for x in got if x.doc_id in (900, 901)}
    assert empty[900] == empty[901] < 0.5
    assert all(x.score < 1e-9 for x in toxicity.toxicity(df, labels.limit(0)).collect())
    assert all(x.score > 1 - 1e-9 for x in toxicity.toxicity(df, labels.where("label = 1")).collect())


def test_remainder_is_crc32_of_text(spark):
    from orrery.llm.common import doc_remainder

    got = spark.range(40).select("id", doc_remainder(F.col("id"), 5).alias("r")).collect()
    assert all(x.r == zlib.crc32(str(x.id).encode()) % 5 for x in got)


def test_rows_keep_their_place(spark, tmp_path):
    """Rows of files are named where they stand; plans that could give other rows a second time are written first."""
    from orrery.llm.common import _reads_rows, with_place

    spark.range(40).repartition(4).write.parquet(str(tmp_path / "x"))
    d = spark.read.parquet(str(tmp_path / "x"))
    plain = lambda df: _reads_rows(df._jdf.queryExecution().analyzed())
    assert plain(d) and plain(d.where("id > 3").withColumn("y", F.col("id") * 2))
    assert not any(map(plain, (d.where(F.rand(1) > 0.5), d.limit(3), d.select(F.explode(F.array("id", "id"))), d.repartition(2), d.unionByName(d), spark.range(3))))
    for df, n in ((d, 40), (d.unionByName(d), 80), (d.repartition(3), 40)):
        got = with_place(df, [F.col("id")])
        assert got.select("__file", "__pos").distinct().count() == n
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in got.collect()}


def plain_ftrl(rows, labels):
    """FTRL-proximal by its definition, a dictionary a coordinate, over rows of distinct features."""
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n = {}, {}

    def weight(k):
        r = 0.0 if k is None else 1.0
        if abs(z.get(k, 0.0)) <= l1 * r:
            return 0.0
        return (math.copysign(l1 * r, z[k]) - z[k]) / ((b + math.sqrt(n[k])) / a + l2 * r)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for d in order.permutation(len(labels)):
            feats = [*rows[d], None]
            w = {k: weight(k) for k in feats}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - labels[d]
            for k in feats:
                before = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / a * w[k]
                n[k] = before + g * g
    return {k: weight(k) for k in z if k is not None and weight(k)}, weight(None)


def test_ftrl_equals_a_plain_one():
    r = random.Random(5)
    rows, labels = [], []
    for _ in range(120):
        y = int(r.random() < 0.3)
        rows.append(sorted({r.randrange(40) for _ in range(r.randint(0, 12))} | ({90 + r.randrange(3)} if y else set())))
        labels.append(y)
    docs, keys = np.repeat(np.arange(120), [len(x) for x in rows]), np.array([k for x in rows for k in x])
    known, weights, bias = toxicity.fit(docs, keys, np.array(labels, float))
    want, want_bias = plain_ftrl(rows, labels)
    assert dict(zip(known.tolist(), weights, strict=True)) == pytest.approx(want) and bias == pytest.approx(want_bias)
    assert 0 < len(want) < 43


def test_lm_score_is_the_sum_over_all_segmentations(spark):
    path = tokenizers.path("piece_bpe_32k.model")
    texts = ["the cat é", "on a mat the cat", "", "zq"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sp = lattice_lm.vocabulary(path)
    train = [w for t in texts[:3] for w in t.split()]
    counts: dict = {}
    for w in train:
        for i in sp.encode(w):
            counts[i] = counts.get(i, 0) + 1
    for prior in (lattice_lm.PRIOR, 1e12):
        model = lattice_lm.lattice(path, counts, 3, prior)
        got = {r.doc_id: r.score for r in lattice_lm.lm_score(df, F.col("doc_id") < 3, path, prior=prior).collect()}
        for k, t in enumerate(texts):
            want = model.end + sum(every_segmentation(model, w) for w in t.split())
            assert got[k] == pytest.approx(want / math.log(10), rel=1e-9)


def test_very_long_texts(spark):
    """A long text is one row like any other: whole, and not held to a prefix."""
    from orrery.llm import line_dedup, quality_rules

    body = "\n".join(" ".join(f"w{(i * 7 + k) % 9000}" for k in range(20)) for i in range(4000))
    df = spark.createDataFrame([(1, body), (2, body + "\nand an end of its own"), (3, "a short one")], "doc_id long, text string")
    lines = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert lines[2].text == "and an end of its own" and lines[1].text == body and lines[2]["__removed"] == 4000
    judged = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert judged[1].n_words == 80_000 and judged[2].n_words == 80_006
    lab = spark.createDataFrame([(1, "w1 w2 w3 w4", "x"), (2, "ä ö ü ß", "y")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.language_id(df.where("doc_id < 3"), lab).collect()} == {"x"}
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, label int")
    assert toxicity.toxicity(df, labels).count() == 3
