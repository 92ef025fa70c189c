import random

import pytest
from pyspark.sql import functions as F

from orrery.llm import packing


def test_whole_and_tight(spark):
    r = random.Random(4)
    docs = [(i, r.choice([0, 3, 100, 511, 512, 900, 3000, 8192, 8193, 30000])) for i in range(400)] + [(None, 700), (7, 40), (9, None)]
    df = spark.createDataFrame(docs, "doc_id long, n_tokens long").withColumns({"piece": F.lit("x"), "shard": F.lit(1), "start": F.lit(2)})
    out = packing.best_fit(df, shard_pieces=150).toPandas()
    assert out.n_tokens.sum() == sum(n or 0 for _, n in docs)
    got = out[out.bin_id.notna()]
    for _, b in got.groupby("bin_id"):
        spans = sorted(zip(b.bin_offset, b.bin_offset + b.n_tokens))
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert b.bin_length.nunique() == 1 and b.bin_length.iloc[0] == min(c for c in packing.LENGTHS if c >= spans[-1][1])
    bins = got.drop_duplicates("bin_id")
    assert got.n_tokens.sum() / bins.bin_length.sum() > 0.93
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_ids_stay_as_they_are(spark):
    big = 9007199254740993
    out = packing.best_fit(spark.createDataFrame([(None, 3), (big, 4), (big, 4), (big + 2, None)], "doc_id long, n_tokens int")).collect()
    assert sorted(x.doc_id or 0 for x in out) == [0, big, big, big + 2]
    out = packing.best_fit(spark.createDataFrame([("a", 3), (None, 9000), ("b", 4)], "doc_id string, n_tokens long")).collect()
    assert sorted((x.doc_id or "", x.n_tokens) for x in out) == [("", 808), ("", 8192), ("a", 3), ("b", 4)]


def plain(sizes, lengths, overhead, attention):
    """The same rule without index structures."""
    lengths, left, bins, out = sorted(lengths), list(sizes), [], []
    price = lambda n: next(c + overhead + c * c / attention for c in lengths if c >= n)
    for s in sizes:
        left.remove(s)
        open_ = [(b["cap"] - b["used"], -k) for k, b in enumerate(bins) if b["cap"] - b["used"] >= s]
        if open_:
            least = min(x for x, _ in open_)
            k = next(k for k in reversed(bins_by_age(bins)) if bins[k]["cap"] - bins[k]["used"] == least)
        else:
            best = None
            for c in lengths:
                if c >= s:
                    held, rest = s, sorted(left, reverse=True)
                    for x in rest:
                        if x <= c - held:
                            held += x
                    if best is None or price(held) / held < best[0] - 1e-12:
                        best = (price(held) / held, c)
            k = len(bins)
            bins.append({"cap": best[1], "used": 0, "at": 0})
        out.append(k)
        bins[k]["used"] += s
        bins[k]["at"] = len(out)
    return out, [next(c for c in lengths if c >= b["used"]) for b in bins]


def bins_by_age(bins):
    return sorted(range(len(bins)), key=lambda k: bins[k]["at"])


@pytest.mark.parametrize("seed", range(6))
def test_equals_a_plain_packer(seed):
    r = random.Random(seed)
    sizes = sorted((min(128, int(r.lognormvariate(2.5, 1.1)) + 1) for _ in range(120)), reverse=True)
    where, _, length = packing.pack(sizes, (16, 32, 64, 128), 1.0, 256.0)
    assert (where, length) == plain(sizes, (16, 32, 64, 128), 1.0, 256.0)


def total(length):
    return sum(packing.cost(c) for c in length)


def test_lengths_are_chosen_jointly():
    r = random.Random(1)
    sizes = sorted((min(8192, int(r.lognormvariate(6.3, 1.2)) + 1) for _ in range(6000)), reverse=True)
    _, _, length = packing.pack(sizes, packing.LENGTHS, packing.OVERHEAD)
    share = {c: length.count(c) / len(length) for c in packing.LENGTHS}
    assert sum(x > 0.02 for x in share.values()) >= 4
    only = []
    for c in packing.LENGTHS:  # one length where it is long enough, else the next
        bins: list = []
        for one in {min(k for k in packing.LENGTHS if k >= max(s, c)) for s in sizes}:
            own = [s for s in sizes if min(k for k in packing.LENGTHS if k >= max(s, c)) == one]
            bins += packing.pack(own, (one,), packing.OVERHEAD)[2]
        only.append(total(bins))
    assert total(length) < min(only)
