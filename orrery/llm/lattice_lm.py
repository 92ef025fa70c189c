"""Subword-lattice language model: the marginal probability of a text over all segmentations.

The pieces are those of an existing subword vocabulary; it is never trained.
Its scores order the pieces by rank, and a piece of rank r starts with weight
1 / (r + ``RANK``).  The training words' best segmentations under the existing
scores, counted over the whole corpus, sharpen these weights; the end of a text
is an event of its own.  A word is a lattice of all its segmentations, and a
log-space forward recursion sums them, so no single segmentation is chosen.  A
character that is no piece enters as its bytes' pieces.

Words meet no pieces across white space, so a text's log-probability is the sum
over its words: each distinct word's lattice is run once, common words are
broadcast, the others are joined.

A unigram base score over whole tokens comes along: sum of
log10((c + 0.5) / (N + 0.5 (V + 1))).

Defined results: a null or empty text has the end token alone; without training
rows N and V are 0 and the pieces keep their starting weights; null ids and
repeated rows are scored each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct_words, lean, parts, staged
from .word_table import PART, counted, least_count

RANK, PRIOR = 100.0, 2000.0


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct runs without ASCII white space, A-Z as a-z; the place of each word among them, the texts' offsets."""
    words, index, at = distinct_words(texts, unicode_space=False)
    same = pc.ascii_lower(words).dictionary_encode()
    return same.dictionary, same.indices.to_numpy()[index] if len(words) else index, at


class Lattice:
    """Log-probabilities (base e) of pieces, and of words over all segmentations."""

    def __init__(self, pieces: dict[str, float], bytes_: list[float], longest: int, end: float) -> None:
        self.pieces, self.bytes, self.longest, self.end = pieces, bytes_, longest, end

    def word(self, word: str) -> float:
        text = "▁" + word
        n, get, most = len(text), self.pieces.get, self.longest
        a = [0.0] * (n + 1)
        exp, log = math.exp, math.log
        for j in range(1, n + 1):
            found = [a[i] + p for i in range(max(0, j - most), j) if (p := get(text[i:j])) is not None]
            if text[j - 1] not in self.pieces:
                found.append(a[j - 1] + sum(self.bytes[b] for b in text[j - 1].encode()))
            if len(found) == 1:
                a[j] = found[0]
            else:
                m = max(found)
                a[j] = m + log(sum([exp(x - m) for x in found]))
        return a[n]


def vocabulary(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def lattice(model_file: str, counts: dict[int, int], texts: int, prior: float = PRIOR) -> Lattice:
    """Weights of the vocabulary's pieces from their scores, worth ``prior`` uses, and from how often the corpus used them."""
    sp = vocabulary(model_file)
    size = sp.get_piece_size()
    usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i))]
    start = np.zeros(size)
    start[usable] = [1 / (RANK + (usable[-1] if sp.is_byte(i) else -sp.get_score(i))) for i in usable]
    start /= start.sum()
    seen = np.zeros(size)
    for i, n in counts.items():
        if start[i]:
            seen[i] = n
    p = (seen + prior * start) / (seen.sum() + prior)
    end = (texts + 1) / (seen.sum() + texts + prior)
    logs = np.log(np.maximum(p, 1e-300)) + math.log1p(-end)
    names = {sp.id_to_piece(i): float(logs[i]) for i in usable if not sp.is_byte(i)}
    bytes_ = [0.0] * 256
    for i in usable:
        if sp.is_byte(i):
            bytes_[int(sp.id_to_piece(i)[3:5], 16)] = float(logs[i])
    return Lattice(names, bytes_, max(map(len, names)), math.log(end))


def piece_counts(words: DataFrame, model_file: str) -> dict[int, int]:
    """How often each piece stands in the training words' best segmentations under the existing scores."""

    def emit(batches):
        sp = vocabulary(model_file)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for b in batches:
            ids = sp.encode(b.column("word").to_pylist(), num_threads=1)
            n = np.repeat(b.column("n_own").to_numpy(), [len(x) for x in ids])
            total += np.bincount(np.array([i for x in ids for i in x], np.int64), n, len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "n"])

    got = words.where("n_own > 0").select("word", "n_own").mapInArrow(lean(emit), "piece int, n long")
    return {r["piece"]: r["n"] for r in got.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # at most one row a piece


def lm_score(docs: DataFrame, train: Column, model_file: str, *, text: str = "text", keep: dict[str, Column] | None = None, prior: float = PRIOR) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score and score (log10) of each row.

    ``prior``: how many uses of pieces the vocabulary's own scores are worth; the larger, the less the corpus moves them.
    """
    keep = keep or {"doc_id": F.col("doc_id")}
    spark = docs.sparkSession
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("text"), train.alias("__train"))
    table = staged(counted(rows, split, also="__train"), "words")
    tokens, kinds = table.agg(F.coalesce(F.sum("n_own"), F.lit(0)), F.count_if(F.col("n_own") > 0)).first()
    texts = rows.where("__train").count()
    tokens, kinds = tokens + texts, kinds + (texts > 0)
    below = tokens + 0.5 * (kinds + 1)
    model = lattice(model_file, piece_counts(table, model_file), texts, prior)
    shared = spark.sparkContext.broadcast(model)

    def probabilities(batches):
        word = shared.value.word
        for b in batches:
            own = b.column("n_own").to_numpy()
            lm = [word(w) / math.log(10) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array((own > 0).astype(np.int64)), pa.array(np.log10((own + 0.5) / below)), pa.array(lm, pa.float64())], ["word", "n", "known", "base", "lm"])

    scored = staged(table.mapInArrow(lean(probabilities), "word string, n long, known long, base double, lm double"), "scored")
    least = least_count(scored)
    common = scored.where(F.col("n") >= least).select("word", "known", "base", "lm").toArrow()
    values = np.zeros((3, common.num_rows + 1))  # the last for words that aren't common
    values[:, :-1] = [common.column(c).to_numpy().astype(float) for c in ("known", "base", "lm")]
    held = spark.sparkContext.broadcast((common.column("word").combine_chunks(), values))
    end = (1.0 if texts else 0.0, math.log10((texts + 0.5) / below), model.end / math.log(10))
    names = list(keep)
    schema = T.StructType([T.StructField("__row", T.LongType()), *rows.drop("text", "__train").schema.fields, *[T.StructField(n, t) for n, t in (("tokens", T.LongType()), ("word", T.StringType()), ("times", T.LongType()), ("known", T.DoubleType()), ("base", T.DoubleType()), ("lm", T.DoubleType()))]])
    added = [f.name for f in schema.fields[1 + len(names) :]]

    def emit(batches):
        """A row for each text, with the sums over its common words, and one for each other word of it."""
        known, values = held.value
        for b in batches:
            for lo, hi in parts(b.column("text"), PART):
                words, index, at = split(b.column("text").slice(lo, hi - lo))
                n, place = hi - lo, pc.fill_null(pc.index_in(words, value_set=known), len(known)).to_numpy(zero_copy_only=False)[index] if len(words) else index
                total = np.zeros((3, n)) + np.array(end)[:, None]
                some = np.flatnonzero(np.diff(at))
                if len(some):
                    total[:, some] += np.add.reduceat(values[:, place], at[some], axis=1)
                rest = np.flatnonzero(place == len(known))
                cell, times = np.unique((np.searchsorted(at, rest, "right") - 1) * max(len(words), 1) + index[rest], return_counts=True)
                which, word = cell // max(len(words), 1), cell % max(len(words), 1)
                m, none = len(cell), np.zeros(len(cell))
                row = b.column("__row").slice(lo, n)
                take = pa.array([*range(n), *[None] * m], pa.int64())
                columns = [pa.concat_arrays([row, row.take(pa.array(which))]), *[b.column(c).slice(lo, n).take(take) for c in names]]
                new = [np.concatenate([np.diff(at) + 1, none.astype(np.int64)]), pa.concat_arrays([pa.nulls(n, pa.string()), words.take(pa.array(word))]), np.concatenate([np.ones(n, np.int64), times.astype(np.int64)]), *[np.concatenate([x, none]) for x in total]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x) for x in new]], ["__row", *names, *added])

    pieces = staged(rows.drop("__train").withColumn("__row", F.monotonically_increasing_id()).mapInArrow(lean(emit), schema), "parts")
    one = pieces.where("word is null").select("__row", *names, "tokens", "known", "base", "lm")
    rest = pieces.where("word is not null").select("__row", "word", "times").join(scored.where(F.col("n") < least), "word")
    rest = rest.groupBy("__row").agg(*[F.sum(F.col("times") * F.col(c)).alias(f"more_{c}") for c in ("known", "base", "lm")])
    whole = lambda c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0.0))
    return one.join(rest, "__row", "left").select(*names, F.col("tokens").alias("n_tokens"), whole("known").cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), whole("base").alias("base_score"), whole("lm").alias("score"))
