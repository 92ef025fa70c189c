"""The distinct-word table: how often each word stands in a corpus, and its common part.

Counting turns texts into distinct words and counts a few megabytes at a time,
so memory doesn't grow with the corpus.  The commonest ``COMMON`` words at
most, which make up most of any text, are a table of proven size: it is
broadcast.  All other words are met by a join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, parts

COMMON = 200_000
#: Bytes of text that are counted at a time.
PART = 8_000_000


def counted(docs: DataFrame, split: Callable[[pa.Array], tuple], *, also: str | None = None) -> DataFrame:
    """word, n, n_own (how often in rows where the boolean column ``also`` holds), from rows with ``text``.

    ``split`` gives the distinct words of texts, the place of each word among them, and the texts' offsets in words.
    """

    def emit(batches):
        for b in batches:
            texts = b.column("text")
            for lo, hi in parts(texts, PART):
                words, index, at = split(texts.slice(lo, hi - lo))
                n = np.bincount(index, minlength=len(words))
                own = np.zeros_like(n)
                if also:
                    flag = np.asarray(b.column(also).slice(lo, hi - lo).to_pylist(), bool)
                    own = np.bincount(index[np.repeat(flag, np.diff(at))], minlength=len(words))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(n[some]), pa.array(own[some])], ["word", "n", "n_own"])

    partial = docs.select(*["text", also] if also else ["text"]).mapInArrow(lean(emit), "word string, n long, n_own long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_own").alias("n_own"))


def least_count(table: DataFrame, most: int = COMMON) -> int:
    """A count that at most ``most`` words of ``table`` reach, and nearly as many; counts go in sixteenths of a power of two."""
    step = F.floor(F.log2("n") * 16)
    sizes = table.where("n > 1").groupBy(step.alias("step")).agg(F.min("n").alias("n"), F.count("*").alias("words")).collect()  # 1,008 rows at most
    total, least = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["step"]):
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    return least
