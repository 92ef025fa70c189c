"""Line dedup: repeated runs of lines found by winnowing, extended, later ones deleted.

Lines without a word are passed over; the others are compared by a 128-bit hash
of their text (white space at the ends aside).  A run is consecutive lines of at
least ``min_words`` words together.  A line goes if it stands in a run that is
equal, line by line, to a run that came earlier: in a document of smaller id,
or higher up in the same one.

Winnowing: the shortest run of ``min_words`` words that begins at a line, and
the shortest that ends there, are windows; the line of smallest hash in a window
is its minimum, and only the minima of a document are its fingerprints.  Equal
runs have equal windows, so they are guaranteed to share a fingerprint.
Positions are joined on fingerprints; what stands in one place only goes no
further.  From each shared position the match is extended both ways, over the
lines before and after it that its windows hold, and compared with the first
place of the same extended lines; windows that aren't the first are deleted, and
overlapping ones delete a run to its full length.  No pairs are formed, so a
passage in a third of all documents costs a row for each place, and fingerprints
and windows in very many places are joined by broadcast instead of a shuffle.

Whole lines are the unit: the part of a passage that begins or ends inside a
line stays.

Defined results: a null text stays null; an empty one stays; a document of
which nothing is left becomes an empty text; rows of null id are never changed
and never count as earlier; rows of one id and one text share their places, so
they don't delete each other, and of rows of one id with different texts each
is cut for itself; a very long text is held whole by one task; an empty table
gives an empty result.  Other columns may have any names but those of the three
added ones, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, lean, mix, parts, staged

_U = np.uint64


def split(text: str) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    """The lines of a text; the numbers, hashes (two columns) and word counts of those with a word (ASCII white space parts words)."""
    lines = text.encode().split(b"\n")
    kept, hashes, counts = [], [], []
    for k, line in enumerate(lines):
        n = len(line.split())
        if n:
            kept.append(k)
            hashes.append(xxhash.xxh3_128_digest(line.strip()))
            counts.append(n)
    return lines, kept, np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2), np.array(counts, np.int64)


def windows(counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest spans of ``min_words`` words, forward from each line and backward."""
    n, total = len(counts), np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(n)
    ahead = np.searchsorted(total, total[:-1] + min_words, "left") - 1
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    fits, fitb = ahead < n, back >= 0
    both = np.concatenate([np.stack([first[fits], ahead[fits]], 1), np.stack([back[fitb], first[fitb]], 1)])
    both = np.unique(both, axis=0)
    return both[:, 0], both[:, 1]


def minima(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The line of smallest hash in each window, the first of equal ones."""
    place = first.copy()
    for k in range(1, int((last - first).max(initial=0)) + 1):
        at = np.flatnonzero(last - first >= k)
        place[at] = np.where(hashes[first[at] + k] < hashes[place[at]], first[at] + k, place[at])
    return place


def extended(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 128-bit hash (two columns) of all lines of each window."""
    out = mix(hashes[first])
    for k in range(1, int((last - first).max(initial=0)) + 1):
        at = np.flatnonzero(last - first >= k)
        out[at] = mix(out[at] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64) + hashes[first[at] + k])
    return out


def repeated(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = 50) -> DataFrame:
    """doc, digest (of the text), cuts: for each document that loses lines, the spans (first, last; of lines with a word) to delete."""

    def fingerprints(batches):
        """Each document's lines as arrays, with its fingerprints: distinct window minima."""
        for b in batches:
            for lo, hi in parts(b.column("text"), 4_000_000):
                which, one, two, words, marks = [], [], [], [], []
                for k, t in enumerate(b.column("text").slice(lo, hi - lo).to_pylist()):
                    _, _, hashes, counts = split(t)
                    if counts.sum() >= min_words:
                        which.append(lo + k)
                        one.append(hashes[:, 0].view(np.int64))
                        two.append(hashes[:, 1].view(np.int64))
                        words.append(counts)
                        marks.append(np.unique(minima(hashes[:, 0], *windows(counts, min_words))))
                take = pa.array(which, pa.int64())
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (one, two, words)]
                yield pa.RecordBatch.from_arrays([b.column("doc").take(take), b.column("digest").take(take), *lists, pa.array(marks, pa.list_(pa.int32()))], ["doc", "digest", "one", "two", "words", "marks"])

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    lines = staged(rows.mapInArrow(lean(fingerprints), "doc long, digest long, one array<long>, two array<long>, words array<long>, marks array<int>"), "lines")

    # Positions, joined on their fingerprints: those that have an equal elsewhere.
    positions = lines.select("doc", "digest", F.explode("marks").alias("at"), F.element_at("one", F.col("at") + 1).alias("mark"))
    place = F.struct("doc", "at")
    marks = positions.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a < b").select("mark", "n")
    most = lines.agg(F.coalesce(F.sum(F.size("marks")), F.lit(0))).first()[0]
    shared = staged(marks, "marks", most // 2)
    found = join_hot(positions, shared, ["mark"]).select("doc", "digest", "at")
    found = found.groupBy("doc", "digest").agg(F.sort_array(F.collect_set("at")).alias("shared"))
    candidates = lines.drop("marks").join(found, ["doc", "digest"])

    def matches(batches):
        """The windows that hold a shared position as their minimum, by the hash of all their lines."""
        for b in batches:
            one, two, words, shared = (b.column(c) for c in ("one", "two", "words", "shared"))
            which, out = [], [[], [], []]
            for k in range(b.num_rows):
                hashes = np.stack([x[k].values.to_numpy().view(np.uint64) for x in (one, two)], 1)
                first, last = windows(words[k].values.to_numpy(), min_words)
                held = np.isin(minima(hashes[:, 0], first, last), shared[k].values.to_numpy())
                first, last = first[held], last[held]
                which.append(np.full(len(first), k))
                for o, x in zip(out, (first, last, extended(hashes, first, last)), strict=True):
                    o.append(x)
            if which:
                take = pa.array(np.concatenate(which))
                first, last, whole = (np.concatenate(o) for o in out)
                new = [pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), *[pa.array(whole[:, j].copy().view(np.int64)) for j in (0, 1)]]
                yield pa.RecordBatch.from_arrays([b.column("doc").take(take), b.column("digest").take(take), *new], ["doc", "digest", "first", "last", "x", "y"])

    spans = staged(candidates.mapInArrow(lean(matches), "doc long, digest long, first int, last int, x long, y long"), "windows")
    discard(lines, shared)
    place = F.struct("doc", "first")
    origin = spans.groupBy("x", "y").agg(F.min(place).alias("origin"), F.max(place).alias("latest"), F.count("*").alias("n")).where("origin < latest").select("x", "y", "n", "origin")
    later = join_hot(spans, staged(origin, "origins", spans.count() // 2), ["x", "y"]).where(place > F.col("origin"))
    return later.groupBy("doc", "digest").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("cuts"))


def line_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = 50) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text``; adds __lines (with a word), __removed and __removed_words."""
    cuts = repeated(docs, text=text, key=key, min_words=min_words).select(F.col("doc").alias("__doc"), F.col("digest").alias("__digest"), F.col("cuts").alias("__cuts"))
    names = [c for c in docs.columns if c not in ("__lines", "__removed", "__removed_words")]
    some, none = docs.select(*names).where(F.col(key).isNotNull()), docs.select(*names).where(F.col(key).isNull())
    joined = some.join(cuts, (F.col(key).cast("long") == F.col("__doc")) & (F.xxhash64(text) == F.col("__digest")), "left").select(*names, "__cuts")
    joined = joined.unionByName(none.withColumn("__cuts", F.lit(None).cast(joined.schema["__cuts"].dataType)))
    schema = docs.select(*names).schema.add("__lines", "long").add("__removed", "long").add("__removed_words", "long")

    def emit(batches):
        for b in batches:
            for lo, hi in parts(b.column(text), 4_000_000):
                texts, cut = b.column(text).slice(lo, hi - lo).to_pylist(), b.column("__cuts").slice(lo, hi - lo).to_pylist()
                n, gone, lost = [], [], []
                for k, (t, spans) in enumerate(zip(texts, cut, strict=True)):
                    lines = (t or "").encode().split(b"\n")
                    kept = [i for i, line in enumerate(lines) if line.strip()]
                    drop = {kept[i] for s in spans or () for i in range(s["first"], s["last"] + 1)}
                    n.append(len(kept))
                    gone.append(len(drop))
                    lost.append(sum(len(lines[i].split()) for i in drop))
                    if drop:
                        left = b"\n".join(x for i, x in enumerate(lines) if i not in drop)
                        texts[k] = left.decode() if left.strip() else ""
                arrays = [pa.array(texts, b.schema.field(text).type) if c == text else b.column(c).slice(lo, hi - lo) for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(lost, pa.int64())], [*names, "__lines", "__removed", "__removed_words"])

    return joined.mapInArrow(lean(emit), schema)


def oracle(min_words: int = 50) -> str:
    """The same in DuckDB SQL: every span against every earlier one of equal text."""
    return f"""with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null),
    l as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from d),
    w as (select *, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') as t, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as n from l),
    k as (select *, row_number() over (partition by doc_id order by i) - 1 as p, sum(n) over (partition by doc_id order by i) as c from w where n > 0),
    g as (select doc_id, list(t order by p) as ts from k group by doc_id),
    sp as (select doc_id, a.p as s, b.p as e, array_to_string(ts[a.p + 1:b.p + 1], chr(10)) as g from k a join k b using (doc_id) join g using (doc_id)
      where a.p <= b.p and b.c - a.c + a.n >= {min_words} and (b.c - a.c + a.n - b.n < {min_words} or b.c - a.c < {min_words})),
    later as (select * from (select *, row_number() over (partition by g order by doc_id, s) as r from sp) where r > 1),
    cut as (select distinct doc_id, i, n from later join k using (doc_id) where p between s and e),
    gone as (select doc_id, count(*) as n, sum(n) as words from cut group by doc_id),
    rest as (select doc_id, string_agg(line, chr(10) order by i) as t from l anti join cut using (doc_id, i) group by doc_id),
    size as (select doc_id, count(*) as n from k group by doc_id)
    select doc_id, coalesce(size.n, 0)::bigint as n_lines, coalesce(gone.n, 0)::bigint as n_removed, coalesce(words, 0)::bigint as removed_words,
      sha256(case when gone.n is null then text when regexp_matches(t, '[^\\x20\\x09-\\x0D]') then t else '' end) as text_sha256
    from documents left join size using (doc_id) left join gone using (doc_id) left join rest using (doc_id)"""
