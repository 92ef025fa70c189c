"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

A document's n-grams are its sets of five consecutive words (fewer, if it has
fewer).  Documents of equal word sequence form one class and go on as one
representative.

Banding: ``BANDS`` bands of ``ROWS`` MinHash values; at similarity 0.8 a pair
shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS, more than
0.99999.  Representatives are shuffled on band hashes, and each is tied to the
least of its bucket only, so a bucket of n costs n rows.  The ties' connected
components are found by large-star and small-star rounds; every pair that
shares a band lies in one component.

Verification: a component's texts meet in tasks and the exact Jaccard
similarity of every pair in them is counted from full n-gram sets.  Components
above ``BLOCK`` texts or ``BLOCK_GRAMS`` are cut into blocks by hash, a task for
each pair of blocks.  Pairs
stay inside the task; it returns a count of links for each text and ties that
span its linked groups, whose components are the final classes.

Buckets, stars of the components' rounds, components and groups of copies of any
size are joined without a hot task: the commonest keys are met by broadcast.

Defined results: a null text or one without words is linked to nothing; equal
word sequences are linked; rows of null id are left out; rows of one id count
as one document (with several texts: one of them, chosen by its hash, stands for
the id throughout); a very long text is held whole by a task, and by those that
verify its component; an empty table gives an empty result.  Only the two named
columns are read, so others may have any names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, flat_utf8, join_hot, lean, mix, slices, staged, word_hashes

N, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 5
#: A block has about so many texts at most, and so many n-grams in all.
BLOCK, BLOCK_GRAMS = 512, 600_000
_U = np.uint64
_ODD = np.random.default_rng(20260202).integers(1, 2**63, 16 * N, dtype=np.uint64) | _U(1)
_SCALE = np.random.default_rng(20260203).integers(1, 2**32, (BANDS * ROWS, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each document and their offsets; word hashes and theirs."""
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(size)])
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    for k in range(n):
        total += padded[k : k + len(words)] * _ODD[k]
    start = np.repeat(at[:-1], size) + (np.arange(ends[-1]) - np.repeat(ends[:-1], size))
    grams = total[start]
    for d in np.flatnonzero((count > 0) & (count < n)):
        own = words[at[d] : at[d + 1]]
        grams[ends[d]] = (own * _ODD[n : n + len(own)]).sum(dtype=np.uint64) + _U(len(own))
    return mix(grams), ends, words, at


def signatures(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[document, band]: hashes of the bands of the documents' MinHash values (all with n-grams)."""
    x = (grams >> _U(32)).astype(np.uint32)
    out = np.empty((len(ends) - 1, BANDS * ROWS), np.uint32)
    first = 0
    while first < len(ends) - 1:
        last = min(max(int(np.searchsorted(ends, ends[first] + 32768, "right")) - 1, first + 1), len(ends) - 1)
        part, cuts = x[ends[first] : ends[last]], ends[first:last] - ends[first]
        for k in range(BANDS * ROWS):
            h = part * _SCALE[k, 0] + _SCALE[k, 1]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[first:last, k] = np.minimum.reduceat(h, cuts)
        first = last
    bands = np.zeros((len(out), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands + out[:, r::ROWS].astype(np.uint64) + _U(r + 1))
    return bands


def sketch(docs: DataFrame) -> DataFrame:
    """doc, digest, same (hash of the word sequence), bands, grams (number), from rows (doc, digest, text)."""

    def emit(batches):
        for b in batches:
            ids, digest, (data, at) = b.column("doc").to_numpy(), b.column("digest").to_numpy(), flat_utf8(b.column("text"))
            for lo, hi in slices(at, 2_000_000):
                grams, ends, words, cuts = shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                some = np.flatnonzero(np.diff(ends))
                if not len(some):
                    continue
                raw = words.tobytes()
                same = [xxhash.xxh3_128_digest(raw[8 * cuts[d] : 8 * cuts[d + 1]]) for d in some]
                bands = signatures(grams, np.append(ends[some], ends[-1]))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][some]), pa.array(digest[lo:hi][some]), pa.array(same, pa.binary()), bands, pa.array(np.diff(ends)[some])], ["doc", "digest", "same", "bands", "grams"])

    return docs.mapInArrow(lean(emit), "doc long, digest long, same binary, bands array<long>, grams long")


def components(ties: DataFrame, name: str) -> DataFrame:
    """node, root: the least node of each connected component, from ties (a, b); single nodes don't appear.

    Large-star and small-star rounds until the ties stay as they are.
    """
    edges, before = staged(ties.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name), None
    most = edges.count()  # no round makes more ties than these
    for _ in itertools.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", "n", F.least("a", "m").alias("m")), name, 2 * most)
        large = staged(join_hot(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name, most)
        discard(edges, least)
        # A node's smaller neighbours are few here: it is never the centre of its star.
        small = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        edges = large.join(small, large["a"] == small["u"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = staged(edges.where("a <> b").distinct(), name, most)
        discard(large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def linked(sets: list[np.ndarray], threshold: float, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of sets with Jaccard similarity of the threshold or more; with ``left``: i < left <= j only."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int)
    owner = np.repeat(np.arange(n), size)
    _, gram, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = held[gram] > 1
    owner, gram = owner[often], gram[often]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    rows = slice(0, n) if left is None else slice(0, left)
    cols = slice(0, n) if left is None else slice(left, n)
    shared = np.zeros((rows.stop - rows.start, cols.stop - cols.start), np.float32)
    cuts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, int)
    for k in range(0, len(cuts), 4096):
        lo, hi = cuts[k], cuts[k + 4096] if k + 4096 < len(cuts) else len(gram)
        column = np.cumsum(np.append(False, gram[lo + 1 : hi] != gram[lo : hi - 1]))
        matrix = np.zeros((n, int(column[-1]) + 1), np.float32)
        matrix[owner[lo:hi], column] = 1
        shared += matrix[rows] @ matrix[cols].T
    either = size[rows][:, None] + size[cols][None, :] - shared
    i, j = np.nonzero(shared >= threshold * either - 1e-6)
    keep = i < j if left is None else np.ones(len(i), bool)
    return i[keep], j[keep] + cols.start


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Ties of each node to the least of its group."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    return [(k, int(root[k])) for k in range(n) if root[k] != k]


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """doc, weight of its links, tie: from rows (doc, copies, text, cell, side) that meet by cell (a, b: blocks)."""

    def cell(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("doc", "ascending")])
        sets, (data, at) = [], flat_utf8(t.column("text"))
        for lo, hi in slices(at, 1_000_000):
            grams, ends, *_ = shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            sets += [np.unique(grams[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        docs, copies, side = (t.column(c).to_numpy() for c in ("doc", "copies", "side"))
        a, b = (x.as_py() for x in key[:2])
        i, j = linked(sets, threshold, None if a == b else int((side == 0).sum()))
        links = np.bincount(i, copies[j], len(docs)) + np.bincount(j, copies[i], len(docs))
        tie = docs.copy()
        for k, root in spanning(i, j, len(docs)):
            tie[k] = docs[root]
        some = links > 0
        return pa.table({"doc": docs[some], "links": links[some].astype(np.int64), "tie": tie[some]})

    return members.groupBy("cell.a", "cell.b", "cell.root").applyInArrow(cell, "doc long, links long, tie long")


def ngram_join(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least id of the linked group), copy_of (least id of equal word sequence), n_links of each id."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    sketches, most = sketch(rows.where("text is not null")), rows.count()
    one = staged(sketches.groupBy("doc").agg(F.min(F.struct("same", "digest", "bands", "grams")).alias("s")).select("doc", "s.same", "s.digest", "s.bands", "s.grams"), "sketch", most)
    classes = staged(one.groupBy("same").agg(F.min(F.struct("doc", "digest", "bands", "grams")).alias("r"), F.count("*").alias("copies")).select("same", F.col("r.doc").alias("rep"), "r.digest", "r.bands", "r.grams", "copies"), "classes", most)

    hashed = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    least = staged(hashed.groupBy("band", "hash").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1"), "buckets", most * BANDS // 2)
    ties = join_hot(hashed, least, ["band", "hash"]).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    found = components(ties, "ties")
    found = staged(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "components", 2 * found.count())
    discard(least)

    # A component of at most BLOCK texts is one cell, several small ones share none; larger ones are cut into blocks.
    placed = found.join(classes.select(F.col("rep").alias("node"), "digest", "copies", "grams"), "node")
    sizes = placed.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"), F.count("*").alias("n"))
    placed = join_hot(placed, staged(sizes, "sizes", most), ["root"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = rows.where("text is not null").join(placed.select(F.col("node").alias("doc"), "digest", "copies", "root", "block", "blocks"), ["doc", "digest"])
    texts = staged(texts.groupBy("doc", "digest", "copies", "root", "block", "blocks").agg(F.min("text").alias("text")), "members")  # a row a document, though its row may be repeated
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.struct("root", F.least("block", other).alias("a"), F.greatest("block", other).alias("b")).alias("cell"), F.when(F.col("block") <= other, 0).otherwise(1).alias("side")))
    members = texts.select("doc", "copies", "text", F.explode(cells).alias("c")).select("doc", "copies", "text", "c.cell", "c.side")
    links = staged(verify(members, threshold), "links")
    discard(texts)

    final = components(links.select(F.col("doc").alias("a"), F.col("tie").alias("b")), "final")
    count = links.groupBy("doc").agg(F.sum("links").alias("links"))
    reps = classes.select("same", "rep", "copies").join(final.withColumnRenamed("node", "rep"), "rep", "left").join(count.withColumnRenamed("doc", "rep"), "rep", "left")
    reps = reps.select("same", "rep", F.coalesce("root", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n"))
    out = join_hot(one.select("doc", "same"), staged(reps, "groups", most), ["same"]).select("doc", "rep", "class", "n_links")
    alone = F.col("doc_id")
    ids = rows.select(F.col("doc").alias("doc_id")).distinct().join(out, F.col("doc_id") == F.col("doc"), "left")
    return ids.select("doc_id", F.coalesce("class", alone).alias("class_id"), F.coalesce("rep", alone).alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def oracle() -> str:
    """The same by brute force in DuckDB SQL: shared n-grams of all pairs, and the closure of the links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents where doc_id is not null),
    g as (select distinct doc_id, array_to_string(w[i:i + {N - 1}], ' ') as gram from d, unnest(range(1, greatest(1, len(w) - {N - 1}) + 1)) as u(i) where len(w) > 0),
    n as (select doc_id, count(*) as n from g group by doc_id),
    x as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b using (gram) where a.doc_id <> b.doc_id group by all),
    l as (select a, b from x join n p on p.doc_id = a join n q on q.doc_id = b where shared >= {THRESHOLD} * (p.n + q.n - shared)),
    r as (select distinct a as doc_id, a as other from l union select r.doc_id, l.b from r join l on r.other = l.a),
    c as (select doc_id, min(other) as class from r group by doc_id),
    s as (select doc_id, min(doc_id) over (partition by w) as copy from d where len(w) > 0),
    k as (select a as doc_id, count(*) as links from l group by a)
    select doc_id, coalesce(class, doc_id) as class_id, coalesce(copy, doc_id) as copy_of, coalesce(links, 0)::bigint as n_links
    from d left join c using (doc_id) left join s using (doc_id) left join k using (doc_id)"""
