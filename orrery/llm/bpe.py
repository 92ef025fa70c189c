"""BPE encoding and decoding through a distinct-word table.

A word is a run without white space; the tokenizer's own splitting never joins
what white space parts, so a text's ids are its words' ids in order.  Words of
ASCII letters count without case, as the tokenizer lower-cases them itself.

Each distinct word of the corpus is encoded once, by the tokenizers library with
an existing tokenizer file, and decoded by joining its ids with the tokenizer's
id-to-piece table.  The commonest words' rows, a table of bounded size, are
broadcast; those of all other words come back by a join on the word and take
their places in the text by position.

Defined results: a null or empty text has no tokens and decodes to an empty
text; null ids and repeated rows are answered each; a very long text is one row
like any other, and is held whole by one task; an empty table gives an empty
result.  Only the text and the ``keep`` columns are read, so others may have any
names; ``keep`` may not use the names of the three added columns.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, distinct_words, flat_binary, lean, parts, slices, staged, sums, with_place
from .word_table import PART, counted, least_count

#: Words whose rows are broadcast, at most; the others' are joined.
COMMON = 500_000
#: White space to the tokenizer; to Python and Arrow also 1C to 1F.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the place of each word among them, the texts' offsets in words.

    Words of ASCII alone are in lower case (special tokens are spelled with ``<|`` and stay).
    """
    odd = pc.fill_null(pc.match_substring_regex(texts, "[\\x1c-\\x1f]"), False)
    if pc.any(odd).as_py():
        lists = [[w for w in WHITE.split(t or "") if w] for t in texts.to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        found = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
        words, index = found.dictionary, found.indices.to_numpy()
    else:
        words, index, at = distinct_words(texts, unicode_space=True)
    plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
    same = pc.if_else(plain, pc.ascii_lower(words), words).dictionary_encode()
    return same.dictionary, same.indices.to_numpy()[index] if len(words) else index, at


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def width(t) -> type:
    """The number type that holds any id of the tokenizer."""
    return np.uint16 if t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32


def encoded(words: DataFrame, path: str) -> DataFrame:
    """word, n, ids and code (the ids as bytes) of each distinct word."""

    def emit(batches):
        t = tokenizer(path)
        kind = width(t)
        for b in batches:
            found = []
            for k in range(0, b.num_rows, 4096):
                found += [e.ids for e in t.encode_batch_fast(b.column("word").slice(k, 4096).to_pylist(), add_special_tokens=False)]
            code = [np.array(x, kind).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(found, pa.list_(pa.int32())), pa.array(code, pa.binary())], ["word", "n", "ids", "code"])

    return words.select("word", "n").mapInArrow(lean(emit), "word string, n long, ids array<int>, code binary")


def decoded(table: DataFrame, t) -> DataFrame:
    """word, n, code and pieces (joined by a space) from rows (word, n, ids, code): ids meet their pieces by a join."""
    pieces = [(i, t.id_to_token(i) or "") for i in range(t.get_vocab_size(with_added_tokens=True))]
    names = F.broadcast(table.sparkSession.createDataFrame(pieces, "id int, piece string"))  # as long as the vocabulary
    each = table.select("word", "n", "code", F.posexplode_outer("ids").alias("at", "id")).join(names, "id", "left")
    whole = each.groupBy("word").agg(F.max("n").alias("n"), F.any_value("code").alias("code"), F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "piece")))).alias("x"))
    return whole.select("word", "n", "code", F.array_join("x.piece", " ").alias("pieces"))


def packed_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked_table(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def rendered(code: pa.Array, kind: type, digits: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many ids each code has, and the ids in decimal, joined by a space."""
    data, ends = flat_binary(code)
    ends = ends // np.dtype(kind).itemsize
    each = digits.take(pa.array(data.view(kind).astype(np.int32)))
    return np.diff(ends), pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each), " ")


def pack_places(places: np.ndarray) -> bytes:
    planes = places.astype(np.uint32).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:3]).tobytes())


def unpack_places(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(3 * n, 1)), np.uint8).reshape(3, n)
    return planes[0].astype(np.int64) | planes[1].astype(np.int64) << 8 | planes[2].astype(np.int64) << 16


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    keep = keep or {"doc_id": F.col("doc_id")}
    names = list(keep)
    rows = with_place(docs, [*[c.alias(f"__k{k}") for k, c in enumerate(keep.values())], F.col(text).alias("text")])
    own = [f"__k{k}" for k in range(len(names))]
    bare = staged(encoded(counted(rows, split), path), "encoded")
    t = tokenizer(path)
    kind, vocabulary = width(t), t.get_vocab_size(with_added_tokens=True)
    table = staged(decoded(bare, t), "words")
    discard(bare)
    least = least_count(table, COMMON)
    # Commonest first: small numbers for most words make short texts of places.
    common = table.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")]).drop_columns(["n"])
    held = docs.sparkSession.sparkContext.broadcast(packed_table(common))

    def placed(batches):
        """Of each part of a batch: its first row, its last, distinct words, index, offsets and each word's place (0: not common)."""
        known = unpacked_table(held.value).column("word").combine_chunks()
        for b in batches:
            for lo, hi in parts(b.column("text"), PART):
                words, index, at = split(b.column("text").slice(lo, hi - lo))
                place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                yield b.slice(lo, hi - lo), words, index, at, place[index] if len(words) else np.zeros(0, np.int64)

    def others(batches):
        """Row, slot and word of each word that isn't common; a slot counts such words of its row."""
        for b, words, index, at, place in placed(batches):
            rest = np.flatnonzero(place == 0)
            row = np.searchsorted(at, rest, "right") - 1
            slot = np.arange(len(rest)) - np.searchsorted(rest, at)[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("__file").take(take), b.column("__pos").take(take), pa.array(slot.astype(np.int32)), words.take(pa.array(index[rest]))], ["__file", "__pos", "slot", "word"])

    def skeleton(batches):
        """Each row's words as places in the common table, 0 for others."""
        for b, _, _, at, place in placed(batches):
            packed = [pack_places(place[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("__file", "__pos", *own)], pa.array(np.diff(at)), pa.array(packed, pa.binary())], ["__file", "__pos", *own, "words", "packed"])

    fields = [T.StructField(n, rows.schema[c].dataType) for n, c in zip(names, own, strict=True)]
    key = [T.StructField("__file", T.LongType()), T.StructField("__pos", T.LongType())]
    tail = rows.select("__file", "__pos", "text").mapInArrow(lean(others), "__file long, __pos long, slot int, word string")
    tail = staged(tail.join(table.where(F.col("n") < least).drop("n"), "word").select("__file", "__pos", "slot", "code", "pieces"), "rest")
    discard(table)
    tail = tail.groupBy("__file", "__pos").agg(F.sort_array(F.collect_list(F.struct("slot", "code", "pieces"))).alias("rest"))
    texts = rows.mapInArrow(lean(skeleton), T.StructType([*key, *[rows.schema[c] for c in own], T.StructField("words", T.LongType()), T.StructField("packed", T.BinaryType())]))
    whole = texts.join(tail, ["__file", "__pos"], "left").drop("__file", "__pos")

    def finish(batches):
        digits = pa.array([str(i) for i in range(vocabulary)])
        known = unpacked_table(held.value)
        size, ids = rendered(known.column("code").combine_chunks(), kind, digits)
        size = np.concatenate([[0], size])
        ids, text = (pa.concat_arrays([pa.array([""]), x]) for x in (ids, known.column("pieces").combine_chunks()))
        for b in batches:
            count = b.column("words").to_numpy()
            for lo, hi in parts_of(count):
                at = np.concatenate([[0], np.cumsum(count[lo:hi])]).astype(np.int64)
                place = np.concatenate([np.zeros(0, np.int64), *[unpack_places(p, n) for p, n in zip(b.column("packed").slice(lo, hi - lo).to_pylist(), count[lo:hi].tolist(), strict=True)]])
                rest = b.column("rest").slice(lo, hi - lo).flatten()  # the rest's words, row by row and by slot
                place[place == 0] = len(size) + np.arange(len(rest))
                more, others = rendered(rest.field("code"), kind, digits)
                each = np.concatenate([size, more])[place]
                bounds, some = pa.array(np.concatenate([[0], np.cumsum(each > 0)])[at].astype(np.int32)), pa.array(place[each > 0])
                done = [pa.array(sums(each, at))]
                for x, y in ((ids, others), (text, rest.field("pieces"))):
                    lines = pc.binary_join(pa.ListArray.from_arrays(bounds, pa.concat_arrays([x, y]).take(some)), " ")
                    done.append(pa.array([hashlib.sha256(z.as_buffer()).hexdigest() for z in lines], pa.string()))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in own], *done], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    done = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return whole.mapInArrow(lean(finish), done)


def parts_of(count: np.ndarray, most: int = 700_000):
    """(first, last) of runs of rows of about ``most`` words."""
    yield from slices(np.concatenate([[0], np.cumsum(count)]), most)
