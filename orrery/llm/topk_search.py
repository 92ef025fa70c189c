"""Exact top-k inner product search over a bit-sliced index.

Every component becomes floor(scale * x).  Rows are dealt to blocks; a block's
index keeps, for each attribute, one bitmap for each bit of its values (less the
attribute's least value in the block, so that no sign is needed).

A query adds slices with bitmap arithmetic: slice i of attribute d counts
``q_d * 2**i``, so it enters one column of weight for each binary digit of
``q_d``; negative digits enter as complements, with a constant taken off at the
end.  Full adders turn three bitmaps of one weight into one of that weight and
one of the next, until each weight has one bitmap: the bit-sliced scores.

Top rows are selected from the most significant slice downward: while the rows
that are surely in and those that agree on all slices so far exceed k, keep
those with the slice's bit.  The rows left on the boundary have equal scores
and are resolved by smallest id.  Scores are exact integers; blocks' winners
are merged by (score, id).

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; vectors meet those of their own length only; repeated
ids are ranked each, a query's own id never; with fewer than k candidates all
are returned; sums must stay within 63 bits, else an error is raised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean

K, SCALE, BLOCK, QUERY_BLOCK = 5, 256, 16_384, 512
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantise(values: Column, scale: int) -> Column:
    return F.transform(values, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


class Slices:
    """The bit-sliced index of a block: rows sorted by id, 64 to a word."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.n, self.dims = vectors.shape
        self.low = vectors.min(0)
        above = (vectors - self.low).astype(np.uint64)
        self.bits = np.array([int(m).bit_length() for m in above.max(0)])
        self.words = -(-self.n // 64)
        self.maps = []
        for d in range(self.dims):
            rows = np.zeros((self.bits[d], self.words * 64), np.uint8)
            for i in range(self.bits[d]):
                rows[i, : self.n] = (above[:, d] >> np.uint64(i)) & np.uint64(1)
            self.maps.append(np.packbits(rows, axis=1, bitorder="little").view(np.uint64))
        self.live = np.packbits(np.arange(self.words * 64) < self.n, bitorder="little").view(np.uint64)

    def scores(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the scores' binary digits, lowest first; what must be added to them."""
        columns: dict[int, list[np.ndarray]] = {}
        base = 0
        for d, q in enumerate(query):
            base += q * int(self.low[d])
            a, maps = abs(q), self.maps[d]
            if not a or not len(maps):
                continue
            if q < 0:  # -a x = a (2^b - 1 - x) - a (2^b - 1)
                maps = ~maps
                base -= a * (2 ** int(self.bits[d]) - 1)
            j = 0
            while a:
                if a & 1:
                    for i in range(len(maps)):
                        columns.setdefault(i + j, []).append(maps[i])
                a >>= 1
                j += 1
        out, weight = [], 0
        carried = np.zeros((0, self.words), np.uint64)
        while weight <= max(columns, default=-1) or len(carried):
            own = columns.get(weight, [])
            stack = np.concatenate([np.array(own, np.uint64).reshape(len(own), self.words), carried])
            carries = []
            while len(stack) > 1:
                third = len(stack) // 3
                if third:
                    a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                    x = a ^ b
                    carries.append((a & b) | (x & c))
                    stack = np.concatenate([x ^ c, stack[3 * third :]])
                else:
                    carries.append(stack[:1] & stack[1:])
                    stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(carries) if carries else np.zeros((0, self.words), np.uint64)
            weight += 1
        return out, base

    def top(self, query: list[int], k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (by score, then by place) and scores of the k best, without the rows ``own``."""
        digits, base = self.scores(query)
        tied, surely = self.live.copy(), np.zeros(self.words, np.uint64)
        for r in own:
            tied[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        chosen = 0
        for digit in reversed(digits):
            high = tied & digit
            n = int(np.bitwise_count(high).sum())
            if chosen + n <= k:
                surely |= high
                chosen += n
                tied &= ~digit
            else:
                tied = high
        rows = np.concatenate([bits(surely), bits(tied)[: k - chosen]])
        score = np.zeros(len(rows), object)
        for w, digit in enumerate(digits):
            score += (((digit[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(int) << w).astype(object) if w < 62 else [int(b) << w for b in (digit[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)]
        score = np.array([int(s) + base for s in score], object)
        order = sorted(range(len(rows)), key=lambda r: (-score[r], rows[r]))
        return rows[order], score[order]


def bits(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search(index: DataFrame, queries: DataFrame, *, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score from rows (id, v) and (id, v) of whole numbers."""
    n, m = index.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    gather = lambda df, parts, name, *more: df.groupBy(F.size("v").alias("dims"), F.pmod(F.xxhash64("id", "v", *more), F.lit(parts)).cast("int").alias(name)).agg(F.sort_array(F.collect_list(F.struct("id", "v", *more))).alias(f"{name}_rows"))
    index = index.withColumn("at", F.monotonically_increasing_id())  # equal rows go to different blocks
    queries = queries.withColumn("copy", F.monotonically_increasing_id())  # a repeated query is answered for each row
    rows = gather(index, blocks, "block", "at").withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    pairs = rows.join(gather(queries, query_blocks, "query", "copy"), ["dims", "query"])
    pairs = pairs.repartition(max(1, min(blocks * query_blocks, 4 * index.sparkSession.sparkContext.defaultParallelism)), "block", "query")

    def emit(batches):
        for b in batches:
            for r in range(b.num_rows):
                held, asked = b.column("block_rows")[r].values, b.column("query_rows")[r].values
                ids, dims = held.field("id").to_numpy(), b.column("dims")[r].as_py()
                vectors = held.field("v").flatten().to_numpy().reshape(len(ids), dims)
                if (np.abs(vectors.astype(float)) > 2**52).any():
                    raise OverflowError("a component needs more than 52 bits")
                made = Slices(vectors)
                q_ids, q_vectors = asked.field("id").to_numpy(), asked.field("v").flatten().to_numpy().reshape(-1, dims)
                out = [[], [], [], []]
                for q, copy, vector in zip(q_ids.tolist(), asked.field("copy").to_pylist(), q_vectors.tolist(), strict=True):
                    own = np.arange(np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right"))
                    best, score = made.top(vector, k, own)
                    if any(abs(s) >= 2**63 for s in score):
                        raise OverflowError("a score needs more than 63 bits")
                    out[0] += [q] * len(best)
                    out[1] += [copy] * len(best)
                    out[2] += ids[best].tolist()
                    out[3] += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "copy", "vec_id", "score"])

    best = pairs.select("dims", "block", "query", "block_rows", "query_rows").mapInArrow(lean(emit), "query_id long, copy long, vec_id long, score long")
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def usable(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v) of the rows whose vector takes part, with whole numbers for components."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return df.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~bad).select(F.col(key).cast("long").alias("id"), quantise(x, scale).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """The k best other rows of each row for which ``is_query`` holds."""
    return search(usable(vectors, key, vector, scale), usable(vectors.where(is_query), key, vector, scale), k=k)


def oracle() -> str:
    return f"""with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from embeddings
      where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
      from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
    select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {K}"""
