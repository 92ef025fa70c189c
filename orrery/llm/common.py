"""Shared plumbing: tables, staged results, and text as flat byte arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}
ROWS_A_FILE = 50_000
#: Ids of 8 bytes that are broadcast at most.
MOST_BROADCAST = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session, as
    in tests, may go without; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="orrery-")
    return _LOCAL["dir"]


def staged(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here,
    and a lost executor costs a read instead of a recomputation.

    Nothing reads the write's shuffles again, so Spark deletes their files when it ends.  A bound on the rows, if known,
    gives the number of files, so that a short table isn't a file for each partition; it is for what comes out of a
    shuffle of no more rows than that, as the last stage gets no more tasks than files.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // ROWS_A_FILE)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _reads_rows(plan) -> bool:
    """Whether a logical plan gives each row of one table once or not at all, and the same rows each time."""
    if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation") or not plan.deterministic():
        return False
    children = plan.children()
    return all(_reads_rows(children.apply(k)) for k in range(children.size()))


def with_place(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` of ``docs`` with __file and __pos, which name the row however often and however cut it is read.

    A row of a file is named by the file and its place in it.  Plans that do more than choose rows and columns of files
    may give other rows, or deal them anew, when a part is computed again, so their rows are written first.
    """
    place = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos")]
    if _reads_rows(docs._jdf.queryExecution().analyzed()):
        try:
            return docs.select(*columns, *place)
        except AnalysisException:  # not a kind of file that numbers its rows
            pass
    rows = docs.select(*columns)
    return staged(rows, "rows").select(*rows.columns, *place)


def bounded(ids: DataFrame) -> DataFrame:
    """Staged ids, marked for broadcast if they are few enough for any executor; more of them are joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def doc_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as one byte array and the n + 1 offsets of its values (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n, offset = len(column), column.offset
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, offset + n + 1)[offset:] if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and the n + 1 offsets of its values (null: empty)."""
    return flat_binary(column.cast(pa.large_string()).cast(pa.large_binary()))


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(emit):
    """``emit`` for mapInArrow, such that what a batch has used is given back before the next one and at the end."""

    def run(batches):
        def fed():
            for b in batches:
                yield b
                del b
                give_back()

        yield from emit(fed())
        give_back()

    return run


def distinct_words(texts: pa.Array, *, unicode_space: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts (null: empty), the place among them of each word, and the texts' n + 1 offsets in words.

    White space is Unicode's, as Python's ``str.split`` has it, or ASCII's space and 9 to 13.
    """
    lists = (pc.utf8_split_whitespace if unicode_space else pc.ascii_split_whitespace)(pc.fill_null(texts.cast(pa.string()), ""))
    found = lists.values.dictionary_encode()
    index, words = found.indices.to_numpy(zero_copy_only=False), found.dictionary
    at = lists.offsets.to_numpy().astype(np.int64)
    at, index = at - at[0], index[at[0] : at[-1]]
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        real = index != empty
        at, index = np.concatenate([[0], np.cumsum(real)])[at], index[real]
    return words, index, at


def slices(offsets: np.ndarray, most: int):
    """Ranges of whole documents of about ``most`` bytes each (one document may be longer)."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def parts(texts: pa.Array, most: int):
    """(first, last) of runs of whole texts of about ``most`` bytes (a longer text stands alone)."""
    yield from slices(flat_utf8(texts)[1], most)


def join_hot(rows: DataFrame, table: DataFrame, key: list[str], hot: int = 1024) -> DataFrame:
    """Inner join with a staged table of one row a key, whose column n says how many rows hold the key.

    The ``hot`` commonest keys, whatever the size, are met by broadcast, so no key of the shuffled rest holds more than
    one in ``hot`` of all rows.  The column n goes.
    """
    few = F.broadcast(table.orderBy(F.desc("n"), *key).limit(hot))  # a bounded number of rows
    met = rows.join(few.drop("n"), key)
    rest = rows.join(few.select(*key), key, "left_anti").join(table.drop("n"), key)
    return met.unionByName(rest)


#: ASCII letters and digits in lower case and all bytes of longer characters; 0 parts words.
WORD_BYTE = np.zeros(256, np.uint8)
WORD_BYTE[0x80:] = np.arange(0x80, 0x100)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    WORD_BYTE[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORD_BYTE[_c] = _c + 32

_BYTE_KEY = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_KEY[0] = 0
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of each word of each document, and the n + 1 offsets of documents in words.

    A word is a run of ASCII letters, digits and non-ASCII bytes; A-Z count as a-z.
    For each of ``stems`` follow the hashes of the words' first so many bytes.
    """
    n = len(offsets) - 1
    none = (np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), *[np.zeros(0, np.uint64)] * len(stems))
    if not len(data):
        return none
    x = WORD_BYTE[data]
    inside = x > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none
    which = np.cumsum(begins, dtype=np.int32)
    place = np.arange(len(x), dtype=np.int64) - starts[np.maximum(which, 1) - 1]
    key = (place.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0xD1B54A32D192ED03)) | _U(1)
    cell = _BYTE_KEY[x] * key
    words = mix(np.add.reduceat(cell, starts))
    return words, np.searchsorted(starts, offsets).astype(np.int64), *[mix(np.add.reduceat(cell * (place < k), starts) + _U(k)) for k in stems]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each part of ``values`` (an empty part: 0)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
