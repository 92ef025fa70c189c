import json

import pytest
from pyspark.sql import functions as F

from orrery.functions import core as C
from orrery.operators import contracts as V
from orrery.sources import scans, shards


def test_configuration(tmp_path):
    (tmp_path / "p.yaml").write_text("root: ${BASE}/x\nevents: 20\nlist: [a, '${BASE}']\n")
    assert scans.read_config(str(tmp_path / "p.yaml"), {"root": str, "events": int}, {"BASE": "/b"}) == {"root": "/b/x", "events": 20, "list": ["a", "/b"]}
    with pytest.raises(ValueError, match="events"):
        scans.read_config(str(tmp_path / "p.yaml"), {"root": str, "events": str}, {"BASE": "/b"})
    with pytest.raises(KeyError, match="BASE"):
        scans.read_config(str(tmp_path / "p.yaml"), {}, {})
    assert scans.merged_config({"a": 1, "b": 2}, {"b": 3}, {"a": None}) == {"a": 1, "b": 3}
    with pytest.raises(KeyError, match="unknown"):
        scans.merged_config({"a": 1}, {"c": 1})


def test_files_are_found_and_paired(spark, tmp_path):
    for name in ("one/A_HEAD.FITS", "one/A_PHOT.FITS.gz", "two/B_HEAD.fits", "two/readme.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    found = scans.discovered(spark, str(tmp_path))
    assert sorted((r.folder, r.name, r.size) for r in found.collect()) == [("one", "A_HEAD.FITS", 3), ("one", "A_PHOT.FITS.gz", 3), ("two", "B_HEAD.fits", 3)]
    assert {(r.folder, r.phot is None) for r in scans.head_pairs(found).collect()} == {("one", False), ("two", True)}


def test_shards_and_compaction(spark, tmp_path):
    heads = spark.createDataFrame([("s", 3), ("s", 1), ("t", 2)], "task string, id int")
    rows = spark.createDataFrame([("s", 1, 0.5), ("s", 3, 0.1), ("s", 3, 0.2)], "task string, id int, v double")
    shards.write_shards(heads, rows, str(tmp_path / "x"), by=["task"], key="id", order=["v"])
    got = {(r.task, r.id): (r.start, r["count"]) for r in spark.read.parquet(str(tmp_path / "x/events")).collect()}
    assert got == {("s", 1): (0, 1), ("s", 3): (1, 2), ("t", 2): (0, 0)}
    assert [r.v for r in spark.read.parquet(str(tmp_path / "x/rows")).where("task = 's'").orderBy("position").collect()] == [0.5, 0.1, 0.2]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        shards.write_shards(heads, rows, str(tmp_path / "x"), by=["task"], key="id", order=["v"])
    catalog = spark.createDataFrame([(3, 0), (1, 1), (9, 2)], "id int, place int")
    a, b = spark.createDataFrame([(1, 1, "a"), (3, 1, "a")], "id int, at int, v string"), spark.createDataFrame([(3, 2, "b"), (4, 2, "b")], "id int, at int, v string")
    assert shards.compact_in_order([a, b], catalog, str(tmp_path / "c"), key="id", newest=["at"], order="place", files=2) == 1
    assert sorted((r.place, r.v) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [(0, "b"), (1, "a")]


def test_versions_and_runs(spark, tmp_path):
    for n in (3, 5):
        shards.publish_latest(spark.range(n), str(tmp_path / "v"), f"run{n}")
    assert shards.read_latest(spark, str(tmp_path / "v")).count() == 5
    assert not shards.resumable(spark, str(tmp_path / "r"), {"a": 1})
    shards.write_success(spark, str(tmp_path / "r"), {"a": 1})
    assert shards.resumable(spark, str(tmp_path / "r"), {"a": 1})
    with pytest.raises(ValueError, match="another run"):
        shards.resumable(spark, str(tmp_path / "r"), {"a": 2})


def test_contracts_fail_by_name(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id int, x double")
    with pytest.raises(ValueError, match="x_in_range"):
        V.fail(V.model_range(df, {"x": (0.0, 2.0)}))
    V.fail(V.model_range(df.where("id = 1"), {"x": (0.0, 2.0)}))
    with pytest.raises(Exception, match="not one to one"):
        V.one_to_one(df, df.where("id = 1"), ["id"], ("_a", "_b")).collect()


def test_splitmix_and_pixels(spark):
    def plain(seed, i):
        m = (1 << 64) - 1
        x = (i + seed + C.SPLITMIX[0]) & m
        x = ((x ^ (x >> 30)) * C.SPLITMIX[1]) & m
        x = ((x ^ (x >> 27)) * C.SPLITMIX[2]) & m
        return x ^ (x >> 31)

    got = spark.range(50).select("id", C.splitmix64(7, F.col("id")).alias("h")).collect()
    assert all(r.h % (1 << 64) == plain(7, r.id) for r in got)
    p = spark.range(12 * 8 * 8)
    for there, back in ((lambda x: C.pix2ang_nest(3, x, 3), lambda a, b: C.ang2pix_nest(3, a, b)), (lambda x: C.pix2ang_ring(8, x), lambda a, b: C.ang2pix_ring(8, a, b))):
        ra, dec = there(F.col("id"))
        again = p.select("id", ra.alias("ra"), dec.alias("dec")).select("id", back(F.col("ra"), F.col("dec")).alias("b"))
        assert again.where("id <> b").count() == 0


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, None)], "b int, a string")
    assert json.loads(df.select(C.canonical_json("b", "a")).first()[0]) == {"a": None, "b": 1} and df.select(C.canonical_json("b", "a")).first()[0].startswith('{"a"')
