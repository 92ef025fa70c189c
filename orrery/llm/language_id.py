"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over bytes: how often each byte
followed each context of up to three bytes.  A byte unseen in a context costs
the context's escape (method C: d / (n + d) for d distinct bytes in n) and is
then coded one order lower, down to a uniform code of 256 bytes.  Statistics are
frozen, so the code length of a byte is a fixed number for its context, and a
text's exact code length under each language is a sum over all of its bytes.

The trees of all languages stand in one structure.  Every context of the
training texts is in it: the commonest have a row of finished code lengths for
every byte, up to ``DENSE`` bytes of table; the others have their escapes and
the bytes that were seen, and look the rest up one order lower.

The trees are fitted on a bounded sample of labelled texts: ``max_train_docs`` a
language, and ``max_train_bytes`` in all, dealt evenly to the languages (a text
longer than its language's part is not in the sample).  So the trees are bounded
too: by ``DENSE``, and by 16 bytes for each byte of the sample.

Defined results: ``und`` with score 0 for a null text or one without a letter,
and for every text if no row is labelled; ties go to the first language in
alphabetical order; repeated rows and null ids are scored each; a very long text
is scored piece by piece to its end; an empty table gives an empty result.  More
than ``MOST_LANGUAGES`` distinct labels raise an error, as labels that are no
languages.  Only the named columns and those of ``keep`` are read, so others may
have any names; ``keep`` may not use lang_pred or score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_utf8, lean

#: White space before a text, bytes in an alphabet, bytes of finished rows, and the most labels.
SPACE, ALL, DENSE, MOST_LANGUAGES = 32, 256, 24_000_000, 512
CHUNK = 1 << 18
#: Bits of difference per which the score doubles its odds, for long texts: evidence counts up to so many bytes.
EVIDENCE = 48


def codes(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, symbol: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For bytes lo..hi as symbols: the symbol, and the first, second and third before it (white space before a text)."""
    space = int(symbol[SPACE])
    s = symbol[data[max(lo - 3, 0) : hi]]
    s = np.concatenate([np.full(3 - min(lo, 3), space), s]).astype(np.int32)
    own, back = s[3:], [s[2:-1].copy(), s[1:-2].copy(), s[:-3].copy()]
    starts = offsets[(offsets[:-1] >= lo - 2).nonzero()[0]] if len(offsets) > 1 else offsets[:0]
    starts = starts[starts < hi]
    for k in range(3):
        for after in range(k + 1):
            p = starts + after - lo
            back[k][p[(p >= 0) & (p < len(own))]] = space
    return own, back


def count_grams(batches, text: str, lang: str):
    """Rows (lang, gram, n) of each batch: how often each context of three and next byte came."""
    same = np.arange(ALL)
    for b in batches:
        data, at = flat_utf8(b.column(text))
        names, which = np.unique(np.asarray(b.column(lang).to_pylist(), dtype=object).astype(str), return_inverse=True)
        for lo in range(0, len(data), CHUNK):
            hi = min(lo + CHUNK, len(data))
            own, (one, two, three) = codes(data, at, lo, hi, same)
            doc = np.searchsorted(at, np.arange(lo, hi), "right") - 1
            cell, n = np.unique((((which[doc].astype(np.int64) * ALL + three) * ALL + two) * ALL + one) * ALL + own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[cell // ALL**4].astype(object), pa.string()), pa.array(cell % ALL**4), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Trees:
    """The context trees of all languages.

    Bytes of the sample are symbols 1.., all others are symbol 0: none of them was ever seen, so each of them costs the
    same in any context.  ``place[context of three]`` is a row of ``table`` or, below 0, a context without a row.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, dense: int = DENSE) -> None:
        self.langs, many = langs, len(langs)
        known = np.unique(np.append(gram % ALL, SPACE))
        self.symbol = np.zeros(ALL, np.int64)
        self.symbol[known] = 1 + np.arange(len(known))
        self.a = a = len(known) + 1
        parts = [self.symbol[(gram >> (8 * k)) & 255] for k in range(4)]
        own = parts[0]
        context = [np.zeros_like(own), parts[1], parts[2] * a + parts[1], (parts[3] * a + parts[2]) * a + parts[1]]
        # Contexts of two and three bytes, shorter ones first, then by how often they came.
        seen = [np.unique(context[k], return_inverse=True) for k in (2, 3)]
        came = [np.bincount(inverse.ravel(), n, len(u)) for u, inverse in seen]
        rows = max(0, dense // (a * max(many, 1) * 4))
        node = [np.full(len(u), -1) for u, _ in seen]
        left, next_row, without = rows, a, []
        for k in (0, 1):
            order = np.argsort(-came[k], kind="stable")
            have = order[: max(left, 0)]
            node[k][have] = next_row + np.arange(len(have))
            next_row, left = next_row + len(have), left - len(have)
            rest = order[len(have) :]
            node[k][rest] = -1 - sum(map(len, without)) - np.arange(len(rest))
            without.append(rest)
        at2 = np.arange(a * a) % a  # a context that was never seen is as good as its shorter one
        at2[seen[0][0]] = node[0]
        self.place = np.tile(at2, a).astype(np.int32)
        self.place[seen[1][0]] = node[1]
        self.lower = np.concatenate([seen[0][0][without[0]] % a, at2[seen[1][0][without[1]] % (a * a)]]).astype(np.int32)
        self.table = np.empty((next_row * a, many), np.float32)
        self.own: list[tuple] = [()] * many
        self.escape: list[tuple] = [()] * many
        of = [node[k][seen[k][1].ravel()] for k in (0, 1)]
        for j in range(many):
            mine = lang == j
            s, m = own[mine], n[mine].astype(float)
            p = self._bits(np.bincount(s, m, a)[None, :], np.full((1, a), 1 / ALL))
            tree = np.zeros((a, a))
            np.add.at(tree, (context[1][mine], s), m)
            ones = self._bits(tree, p)
            self.table[: a * a, j] = -np.log2(ones).ravel()
            keys, costs, nodes, escapes = [], [], [], []
            for k in (0, 1):
                here = of[k][mine]
                with_row = here >= 0
                low = at2[seen[1][0] % (a * a)] if k else seen[0][0] % a
                # Rows: finished code lengths for every symbol.
                picked = np.flatnonzero(node[k] >= 0)
                if len(picked):
                    first = int(node[k][picked].min())
                    tree = np.zeros((len(picked), a))
                    np.add.at(tree, (here[with_row] - first, s[with_row]), m[with_row])
                    by_row = picked[np.argsort(node[k][picked])]
                    below = np.exp2(-self._lower_rows(low[by_row], j, keys, costs, nodes, escapes))
                    self.table[first * a : (first + len(picked)) * a, j] = -np.log2(self._bits(tree, below)).ravel()
                # The others: seen symbols and escapes.
                key = (-1 - here[~with_row]) * a + s[~with_row]
                key, inverse = np.unique(key, return_inverse=True)
                c = np.bincount(inverse.ravel(), m[~with_row], len(key))
                u, back = np.unique(key // a, return_inverse=True)
                total, kinds = np.bincount(back.ravel(), c, len(u)), np.bincount(back.ravel(), minlength=len(u))
                keys.append(key)
                costs.append(-np.log2(c / (total + kinds)[back.ravel()]) if len(key) else c)
                nodes.append(u)
                escapes.append(np.log2((total + kinds) / np.maximum(kinds, 1)))
                self.own[j] = (np.concatenate(keys), np.concatenate(costs).astype(np.float32))
                self.escape[j] = (np.concatenate(nodes), np.concatenate(escapes).astype(np.float32))

    @staticmethod
    def _bits(tree: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of one order from its counts [context, symbol] and those one order lower."""
        n, d = tree.sum(1, keepdims=True), (tree > 0).sum(1, keepdims=True)
        return np.where(n > 0, np.where(tree > 0, tree, d * lower) / np.maximum(n + d, 1), lower)

    def _lower_rows(self, node: np.ndarray, j: int, *_) -> np.ndarray:
        """[context, symbol]: code lengths in the given lower contexts, under language j."""
        every = np.arange(self.a)
        return self.cost(np.repeat(node, self.a), np.tile(every, len(node)), [j])[:, 0].reshape(len(node), self.a).astype(float)

    def cost(self, node: np.ndarray, own: np.ndarray, langs: list[int] | None = None) -> np.ndarray:
        """[position, language]: code lengths in bits of symbols in their contexts."""
        table = self.table if langs is None else self.table[:, langs]
        out = table[np.maximum(node, 0) * self.a + own]
        rest = np.flatnonzero(node < 0)
        if len(rest):
            j, s = -1 - node[rest].astype(np.int64), own[rest]
            low = self.cost(self.lower[j], s, langs)
            for column, k in enumerate(range(len(self.langs)) if langs is None else langs):
                keys, costs = self.own[k]
                nodes, escapes = self.escape[k]
                if len(nodes):
                    at = np.minimum(np.searchsorted(nodes, j), len(nodes) - 1)
                    low[:, column] += np.where(nodes[at] == j, escapes[at], 0)
                    at = np.minimum(np.searchsorted(keys, j * self.a + s), len(keys) - 1)
                    low[:, column] = np.where(keys[at] == j * self.a + s, costs[at], low[:, column])
            out[rest] = low
        return out


def train(labelled: DataFrame, *, text: str, lang: str, key: str, max_train_docs: int, max_train_bytes: int) -> Trees | None:
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("lang"))
    names = [r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct labels")
    if not names:
        return None
    each = max_train_bytes // len(names)
    rows = rows.withColumn("size", F.octet_length("t")).where(F.col("size") <= each)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()  # a row a language
    part = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(int(1_000_000 * min(1, max_train_docs / r["n"], each / max(r["size"], 1))))) for r in sizes], F.lit(0))
    rows = rows.where(F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1_000_000)) < part)
    grams = rows.select("t", "lang").mapInArrow(lean(lambda bs: count_grams(bs, "t", "lang")), "lang string, gram long, n long")
    got = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(names)
    which = np.searchsorted(langs, got.column("lang").to_pylist()) if got.num_rows else np.zeros(0, int)
    return Trees(langs, which, got.column("gram").to_numpy(), got.column("n").to_numpy())


def lengths(data: np.ndarray, offsets: np.ndarray, trees: Trees) -> np.ndarray:
    """[document, language]: exact code length of each whole text, in bits."""
    total = np.zeros((len(offsets) - 1, len(trees.langs)))
    step = max(1024, 4 * CHUNK // max(4, len(trees.langs)))  # positions times languages at a time
    for lo in range(0, len(data), step):
        hi = min(lo + step, len(data))
        own, (one, two, three) = codes(data, offsets, lo, hi, trees.symbol)
        cost = trees.cost(trees.place[(three * trees.a + two) * trees.a + one], own)
        first = int(np.searchsorted(offsets, lo, "right")) - 1
        last = int(np.searchsorted(offsets, hi, "left"))
        cuts = np.clip(offsets[first:last], lo, hi) - lo
        some = np.flatnonzero(np.diff(np.append(cuts, hi - lo)) > 0)
        total[first + some] += np.add.reduceat(cost, cuts[some], axis=0, dtype=np.float64)
    return total


def score(docs: DataFrame, model: Trees | None, *, text: str, keep: dict[str, Column]) -> DataFrame:
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), list(keep)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    out = T.StructType([*rows.drop("__text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def emit(batches):
        trees = shared.value
        langs = trees.langs if trees else []
        names = np.array([*langs, "und"], object)
        for b in batches:
            column = b.column("__text")
            data, at = flat_utf8(column)
            n = np.diff(at)
            if not langs:
                best, p = np.zeros(len(n), int), np.zeros(len(n))
            else:
                cost = lengths(data, at, trees)
                best = cost.argmin(1)
                over = (cost - cost.min(1, keepdims=True)) * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
                p = 1 / np.exp2(-np.minimum(over, 200)).sum(1)
                plain, some = np.zeros(len(n), bool), np.flatnonzero(n)
                if len(some):
                    plain[some] = np.logical_or.reduceat(ascii_letter[data], at[some])
                for k in np.flatnonzero(~plain):
                    if not any(map(str.isalpha, column[int(k)].as_py() or "")):
                        best[k], p[k] = len(langs), 0.0
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(names[best], pa.string()), pa.array(p)], [*kept, "lang_pred", "score"])

    return rows.mapInArrow(lean(emit), out)


def language_id(docs: DataFrame, labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", keep: dict[str, Column] | None = None, max_train_docs: int = 1500, max_train_bytes: int = 16_000_000) -> DataFrame:
    """Learn from ``labelled`` (key, text, lang) and predict the language of every text of ``docs``."""
    model = train(labelled, text=text, lang=lang, key=key, max_train_docs=max_train_docs, max_train_bytes=max_train_bytes)
    return score(docs, model, text=text, keep=keep or {key: F.col(key)})
