"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of that length and
a rest; no token is lost.  Pieces are dealt by hash to shards of about
``shard_pieces``, and each shard packs its own, longest first: a piece goes to
the open bin that it leaves least room in.  If none takes it, a bin opens.

Its length is chosen jointly for all pieces still to come: a sequence costs its
tokens, a fixed ``overhead`` and, as attention does, its length squared over
``attention``; for each permitted length the bin is filled on trial with the
longest remaining pieces that fit, and the length of least cost for each token
that it would hold is opened.  Long bins waste little on mixed sizes and short
ones cost less, so several lengths are in use.  At the end each bin is cut down
to the smallest permitted length that holds its contents.

Defined results: a text without words has no pieces and is in no bin (one row,
bin null); a null number of tokens counts as none; ids of any type, null ones
and repeated rows are packed each as they are; a very long text is cut into
pieces; an empty table gives an empty result.  Columns but the two named are not
read.  Bin ids are ``shard * 2**32 + number``.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD, ATTENTION = 16.0, 32_768.0


def cost(length: float, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return length + overhead + length * length / attention


class Sizes:
    """How many pieces of each size are left; the sizes that are there stand as bits of one number."""

    def __init__(self, sizes: list[int]) -> None:
        self.left, self.mask = {}, 0
        for s in sizes:
            self.left[s] = self.left.get(s, 0) + 1
            self.mask |= 1 << s

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            self.mask ^= 1 << size

    def fill(self, room: int) -> int:
        """Tokens of the longest remaining pieces, one after the other, that fit into ``room``."""
        mask, used, held, size = self.mask, 0, 0, room
        while True:
            below = mask & ((1 << (min(size, room - used) + 1)) - 1)
            if not below:
                return used
            size = below.bit_length() - 1
            held = min(self.left[size], (room - used) // size)
            used += held * size
            size -= 1


def pack(sizes: list[int], lengths: tuple[int, ...], overhead: float, attention: float = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """For pieces in falling order: bin and offset of each; the final length of each bin."""
    lengths = tuple(sorted(lengths))
    price = {c: cost(c, overhead, attention) for c in lengths}
    room: dict[int, list[int]] = {}
    mask, left = 0, Sizes(sizes)
    used, capacity, where, offset = [], [], [], []
    for size in sizes:
        left.take(size)
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            k = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            k = len(used)
            some = [c for c in lengths if c >= size]
            held = {c: size + left.fill(c - size) for c in some}
            # What the contents would be cut down to is what they cost.
            final = {c: price[lengths[bisect.bisect_left(lengths, held[c])]] for c in some}
            capacity.append(min(some, key=lambda c: (final[c] / held[c], c)))
            used.append(0)
        where.append(k)
        offset.append(used[k])
        used[k] += size
        free = capacity[k] - used[k]
        if free:
            room.setdefault(free, []).append(k)
            mask |= 1 << free
    return where, offset, [lengths[bisect.bisect_left(lengths, u)] for u in used]


def best_fit(pieces: DataFrame, *, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION, shard_pieces: int = 20_000) -> DataFrame:
    """Pack rows (doc_id, n_tokens): doc_id, piece, start, n_tokens, bin_id, bin_length, bin_offset."""
    longest = F.lit(max(lengths)).cast("long")
    rows = staged(pieces.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens")), "sizes")
    total = rows.agg(F.coalesce(F.sum(F.ceil(F.col("n_tokens") / longest)), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_pieces))
    out = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("bin_id", T.LongType()), ("bin_length", T.IntegerType()), ("bin_offset", T.IntegerType()))]])
    # The row's place is part of the draw: equal ids and sizes go to different shards.
    some = rows.where("n_tokens > 0").select("doc_id", "n_tokens", F.col("_metadata.row_index").alias("row"))
    some = some.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / longest))))
    some = some.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), F.least(longest, F.col("n_tokens") - F.col("piece") * longest).alias("n_tokens"), F.pmod(F.xxhash64("row", "doc_id", "piece", "n_tokens"), F.lit(shards)).alias("shard"))

    def shard(t: pa.Table) -> pa.Table:
        order = [("n_tokens", "descending"), *([("doc_id", "ascending")] if pa.types.is_primitive(t.schema.field("doc_id").type) or pa.types.is_string(t.schema.field("doc_id").type) else []), ("start", "ascending")]
        t = t.sort_by(order)
        where, offset, length = pack(t.column("n_tokens").to_pylist(), lengths, overhead, attention)
        bins = np.array(where, np.int64)
        number = t.column("shard").to_numpy().astype(np.int64) * 2**32 + bins
        new = [pa.array(number), pa.array(np.array(length, np.int32)[bins]), pa.array(np.array(offset, np.int32))]
        return pa.Table.from_arrays([*[t.column(c) for c in ("doc_id", "piece", "start", "n_tokens")], *new], names=out.names)

    packed = some.groupBy("shard").applyInArrow(shard, out)
    empty = rows.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "n_tokens", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("bin_offset"))
    return packed.unionByName(empty)


def tokens(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and n_tokens: runs without ASCII white space, and one for the document's end."""
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(key).alias("doc_id"), F.when(n > 0, n + 1).otherwise(0).cast("long").alias("n_tokens"))
