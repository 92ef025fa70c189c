"""Toxicity score: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the words, their stems (the first four and six bytes,
which inflected forms share), word pairs and pairs around one word that it
holds, each hashed to 32 bits and counted once.  FTRL-proximal learns them
with a rate per coordinate; its L1 term leaves most weights at exactly 0, so
the model is a short sorted list that is broadcast.

The model is fitted on a bounded sample of labelled rows (``max_train_docs``,
``max_train_words``); every whole text is scored.

Defined results: a null or empty text has no features and gets the bias alone;
labels without id or value are
not learned from, any above 0 counts as 1, and an id with several labels has the largest; with no labelled rows, or labels of one class, every score is the share
of label 1 (0 without labels).  Repeated rows and rows of null id are scored each; a very long text is
scored piece by piece to its end, and learned from if it is no longer than the
whole sample may be; an empty table gives an empty result.  Only the named
columns and those of ``keep`` are read, so others may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_utf8, lean, mix, slices, word_hashes

_U = np.uint64
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 1.0, 5
#: Features of fewer training documents can't be told from chance.
LEAST_DOCS = 3
STEMS = (4, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each distinct feature of each document, in order of document."""
    words, at, *stems = word_hashes(data, offsets, STEMS)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(at))
    parts = [(doc, words), *[(doc, s) for s in stems]]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = doc[:-gap] == doc[gap:]
        parts.append((doc[:-gap][same], mix(words[:-gap] * _U(salt) + words[gap:])[same]))
    doc = np.concatenate([p[0] for p in parts])
    keys = np.concatenate([p[1] for p in parts]) >> _U(32)
    return doc, keys.astype(np.int64)


def fit(docs: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the sparse rows (docs, keys): sorted keys, their weights, the bias."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(0, np.int64), np.zeros(0), 40.0 if share else -40.0
    known, column = np.unique(keys, return_inverse=True)
    order = np.argsort(docs, kind="stable")
    column, ends = column[order] + 1, np.searchsorted(docs[order], np.arange(len(labels) + 1))
    z, n, w = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    rows = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for d in rows.permutation(len(labels)):
            at = np.append(column[ends[d] : ends[d + 1]], 0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) > L1 * (at > 0), (np.sign(zi) * L1 * (at > 0) - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2 * (at > 0)), 0.0)
            p = 1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35)))
            g = p - labels[d]
            rate = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - rate * wi
            n[at] += g * g
    l1 = np.full(len(z), L1)
    l1[0] = 0
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + np.where(l1 > 0, L2, 0)), 0.0)
    kept = np.flatnonzero(w[1:])
    return known[kept], w[1:][kept], float(w[0])


def learn(ids: np.ndarray, text: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on texts in order of id; features of fewer than LEAST_DOCS texts are found first, by count of a 24-bit hash, and left out."""
    order = np.argsort(ids, kind="stable")
    data, at = flat_utf8(text.take(pa.array(order)))
    count, mask = np.zeros(1 << 24, np.int32), (1 << 24) - 1
    for lo, hi in slices(at, 2_000_000):
        doc, keys = features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        both = np.unique(doc << 32 | keys)
        count += np.bincount(both & mask, minlength=1 << 24).astype(np.int32)
    docs, kept = [], []
    for lo, hi in slices(at, 2_000_000):
        doc, keys = features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        often = count[keys & mask] >= LEAST_DOCS
        both = np.unique(doc[often] << 32 | keys[often])
        docs.append((both >> 32) + lo)
        kept.append(both & 0xFFFFFFFF)
    return fit(np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, np.int64), *kept]), labels[order].astype(float))


def train(docs: DataFrame, labels: DataFrame, *, text: str, label: str, key: str, max_train_docs: int, max_train_words: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on the texts of labelled ids; of more than the bounds allow, a sample by hash of the id.

    The sample of (key, label) is drawn first, so the table that meets the texts has a bounded number of rows.
    """
    few = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).cast("int").alias("y"))
    draw = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1_000_000))
    few = few.where(draw < int(1_000_000 * min(1.0, max_train_docs / max(few.count(), 1))))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(few), "k").where(F.length("t") <= 6 * max_train_words)
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    rows = rows.where(F.pmod(F.xxhash64("k", F.lit(12)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_train_words * 6 / max(chars, 1))))

    def emit(batches):
        found = [b for b in batches if b.num_rows]
        if found:
            t = pa.Table.from_batches(found)
            keys, weights, bias = learn(t.column("k").to_numpy(), t.column("t").combine_chunks(), t.column("y").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, -1)), pa.array(np.append(weights, bias))], ["k", "w"])

    # The sample is bounded, so one task holds it; only weights that are not 0 come back.
    got = rows.repartition(1).mapInArrow(lean(emit), "k long, w double").toArrow()
    k, w = got.column("k").to_numpy(), got.column("w").to_numpy()
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0), -40.0
    return k[:-1], w[:-1], float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text: str, keep: dict[str, Column]) -> DataFrame:
    """``keep`` columns and ``score`` of every row."""
    spark = docs.sparkSession
    keys, weights, bias = model
    marks = np.zeros(1 << 20, bool)
    marks[keys & ((1 << 20) - 1)] = True
    shared, names = spark.sparkContext.broadcast((keys, weights, bias, marks)), list(keep)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    out = T.StructType([*rows.drop("__text").schema.fields, T.StructField("score", T.DoubleType())])

    def emit(batches):
        known, weight, start, hit = shared.value
        for b in batches:
            data, at = flat_utf8(b.column("__text"))
            total = np.full(b.num_rows, start)
            for lo, hi in slices(at, 4_000_000):
                doc, f = features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                some = np.flatnonzero(hit[f & ((1 << 20) - 1)])
                doc, f = doc[some], f[some]
                place = np.minimum(np.searchsorted(known, f), max(len(known) - 1, 0))
                if len(known):
                    real = known[place] == f
                    cell = np.unique(doc[real] * len(known) + place[real])
                    np.add.at(total, lo + cell // len(known), weight[cell % len(known)])
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(p)], [*names, "score"])

    return rows.mapInArrow(lean(emit), out)


def toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "label", key: str = "doc_id", keep: dict[str, Column] | None = None, max_train_docs: int = 16_000, max_train_words: int = 6_000_000) -> DataFrame:
    """Learn from the texts of the ids in ``labels`` (key, label 0 or 1) and score every text of ``docs``."""
    model = train(docs, labels, text=text, label=label, key=key, max_train_docs=max_train_docs, max_train_words=max_train_words)
    return score(docs, model, text=text, keep=keep or {key: F.col(key)})
