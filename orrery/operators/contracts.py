"""Data contracts: each lists its rules with how many rows break them, in one pass or one join.

``fail`` turns such a list into an error that names the broken rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C


def counted(df: DataFrame, rules: dict[str, Column], *, by: list[str] | None = None) -> DataFrame:
    """rule, n for every rule, kept ones too (n = 0): how many rows break it; a null predicate counts as broken."""
    g = df.groupBy(*by) if by else df.groupBy()
    counts = g.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])
    return counts.select(*(by or []), F.inline(pairs))


def fail(rules: DataFrame) -> None:
    broken = {r["rule"]: r["n"] for r in rules.where("n > 0").collect()}  # a row a rule
    if broken:
        raise ValueError(f"contract broken: {broken}")


def derived_label(a: Column, b: Column) -> Column:
    """The negative kind of an event whose two components are both zero."""
    return F.when((a == 0) & (b == 0), "no_ejecta").otherwise("none")


def label_consistency(df: DataFrame, *, label: str, a: str, b: str) -> DataFrame:
    """A label, where given, says no_ejecta exactly if both components are zero."""
    derived = derived_label(F.col(a), F.col(b))
    return counted(df, {"label_without_zero": ~((F.col(label) == "no_ejecta") & (derived == "none")) | F.col(label).isNull(), "zero_without_label": ~((F.col(label) != "no_ejecta") & (derived == "no_ejecta")) | F.col(label).isNull()})


def model_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return counted(df, {f"{c}_in_range": C.finite(F.col(c)) & F.col(c).between(*r) for c, r in ranges.items()})


def referenced_files(rows: DataFrame, listing: DataFrame, *, key: str, path: str) -> DataFrame:
    """Each row's file is in the listing (column path) and is named after its key."""
    seen = rows.join(listing.select(F.col("path").alias(path)).distinct().withColumn("__there", F.lit(True)), path, "left")
    name = F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    return counted(seen, {"file_exists": F.col("__there"), "file_name": name == F.concat(F.col(key).cast("string"), F.lit(".fits"))})


def namespace(rows: DataFrame, *, key: str, source: str, split: str, kind: str, uid: str, kinds: list[str]) -> DataFrame:
    """Known class, canonical uid and unique uid of every row."""
    canonical = F.concat_ws("_", source, split, kind, F.col(key).cast("string"))
    n = F.count("*").over(Window.partitionBy(uid))
    return counted(rows.withColumn("__n", n), {"known_class": F.col(kind).isin(kinds), "canonical_uid": F.col(uid) == canonical, "unique_uid": F.col("__n") == 1})


def payload(heads: DataFrame, rows: DataFrame, *, key: str, start: str, count: str, value: str) -> DataFrame:
    """Heads (key, start, count) against their rows: as many as said, offsets that follow one another, finite values."""
    have = rows.groupBy(key).agg(F.count("*").alias("__rows"), F.count_if(~F.coalesce(C.finite(F.col(value)), F.lit(False))).alias("__bad"))
    before = F.coalesce(F.sum(count).over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = heads.withColumn("__before", before).join(have, key, "left")
    return counted(h, {"count": F.col(count) == F.coalesce("__rows", F.lit(0)), "offset": F.col(start) == F.col("__before"), "finite": F.coalesce("__bad", F.lit(0)) == 0, "nonempty": F.col(count) > 0})


def against_catalog(events: DataFrame, catalog: DataFrame, *, key: str, order: str, status: str, plan: str) -> DataFrame:
    """An aggregate holds the catalogue's events, each once and in its order, with known states; successes have a plan."""
    both = events.withColumn("__e", F.lit(1)).join(catalog.select(key, F.col(order).alias("__o"), F.lit(1).alias("__c")), key, "full")
    both = both.withColumn("__n", F.count("__e").over(Window.partitionBy(key)))
    rules = {
        "missing": F.col("__e").isNotNull(), "unknown": F.col("__c").isNotNull(), "once": F.col("__n") <= 1, "order": F.col("__e").isNull() | F.col("__c").isNull() | (F.col(order) == F.col("__o")),
        "status": F.col("__e").isNull() | F.col(status).isin("success", "failed", "skipped"), "plan": (F.coalesce(F.col(status), F.lit("")) != "success") | F.col(plan).isNotNull(),
    }
    return counted(both, rules)


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, digest: of the rows as a bag, whatever their order: a sum of hashes of canonical text."""
    h = C.hash32(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("long").alias("digest"))


def handed_off(now: DataFrame, then: DataFrame, columns: list[str]) -> DataFrame:
    """check, same: whether a snapshot still has the rows, the digest and the columns that it had when it was handed on."""
    a, b = digest(now, columns), digest(then, columns).withColumnsRenamed({"rows": "rows_then", "digest": "digest_then"})
    both = a.join(F.broadcast(b))  # a row each
    schema = sorted(now.dtypes) == sorted(then.dtypes)
    return both.select(F.inline(F.array(F.struct(F.lit("rows").alias("check"), (F.col("rows") == F.col("rows_then")).alias("same")), F.struct(F.lit("digest").alias("check"), (F.col("digest") == F.col("digest_then")).alias("same")), F.struct(F.lit("schema").alias("check"), F.lit(schema).alias("same")))))


def coverage(events: DataFrame, rows: DataFrame, *, key: str, status: str) -> DataFrame:
    """Successes have rows, others have none; legacy events have no status at all."""
    have = rows.select(key).distinct().withColumn("__rows", F.lit(True))
    j = events.join(have, key, "left")
    has = F.coalesce("__rows", F.lit(False))
    return counted(j, {"success_without_rows": (F.coalesce(F.col(status), F.lit("")) != "success") | has, "rows_without_success": ~has | F.col(status).isNull() | (F.col(status) == "success"), "legacy": F.col(status).isNotNull()})


def requested(catalog: DataFrame, wanted: DataFrame, *, key: str, finite: list[str], snr: str) -> DataFrame:
    """Every wanted id is in the catalogue, once, with finite values and no negative signal."""
    have = wanted.select(key).distinct().join(catalog.withColumn("__c", F.lit(1)), key, "left").withColumn("__n", F.count("__c").over(Window.partitionBy(key)))
    ok = F.lit(True)
    for c in finite:
        ok = ok & C.finite(F.col(c))
    return counted(have, {"present": F.col("__c").isNotNull(), "unique": F.col("__n") <= 1, "finite": F.col("__c").isNull() | ok, "signal": F.col("__c").isNull() | (F.col(snr) >= 0)})


def compatible(manifests: DataFrame, *, run: str, fields: list[str]) -> DataFrame:
    """field, values, same: whether all runs agree on each field of their manifests (nulls count as a value)."""
    rows = manifests.select(run, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("~")).alias("value")) for f in fields])).alias("x")).select(run, "x.*")
    return rows.groupBy("field").agg(F.count_distinct("value").alias("values")).withColumn("same", F.col("values") == 1)


def edges(bins: DataFrame, *, by: list[str], order: str, low: str, high: str) -> DataFrame:
    """Bins rise strictly and follow one another without gap or overlap."""
    w = Window.partitionBy(*by).orderBy(order)
    b = bins.withColumn("__last", F.lag(high).over(w))
    return counted(b, {"rising": F.col(low) < F.col(high), "joined": F.col("__last").isNull() | (F.col("__last") == F.col(low))})


def scenario_faults(rows: DataFrame, *, scenario: str, constant: list[str], unique: str, truth: str) -> DataFrame:
    """Fields that must not vary within a scenario do not, ids are unique in it, and it has exactly one truth row."""
    g = rows.groupBy(scenario).agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("~"))).alias(f"__{c}") for c in constant], F.count("*").alias("__n"), F.count_distinct(unique).alias("__u"), F.count_if(truth).alias("__t"))
    return counted(g, {**{f"constant_{c}": F.col(f"__{c}") == 1 for c in constant}, "unique_id": F.col("__u") == F.col("__n"), "one_truth": F.col("__t") == 1})


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join of two sides that must match one to one and fully; a row that has no partner, or several, is an error."""
    a = left.select(*on, *[F.col(c).alias(c + suffixes[0]) for c in left.columns if c not in on], F.lit(1).alias("__a"))
    b = right.select(*on, *[F.col(c).alias(c + suffixes[1]) for c in right.columns if c not in on], F.lit(1).alias("__b"))
    j = a.join(b, on, "full").withColumn("__n", F.count("*").over(Window.partitionBy(*on)))
    named = F.concat_ws("|", *[F.col(c).cast("string") for c in on])
    fine = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__n") == 1)
    return j.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("not one to one: "), named)).cast("boolean"))).drop("__a", "__b", "__n")


def collapsed(rows: DataFrame, key: list[str], *, first: list[str], mean: list[str], repeat: str) -> tuple[DataFrame, DataFrame]:
    """(a row a key: attributes, means over repeats, their number; and a list of rules: equal coverage, constant attributes)."""
    g = rows.groupBy(*key).agg(*[F.min(c).alias(c) for c in first], *[F.count_distinct(c).alias(f"__{c}") for c in first], *[F.avg(c).alias(c) for c in mean], F.count_distinct(repeat).alias("repeats"))
    total = rows.agg(F.count_distinct(repeat).alias("__total"))
    checked = g.join(F.broadcast(total))  # one row
    rules = counted(checked, {"equal_coverage": F.col("repeats") == F.col("__total"), **{f"constant_{c}": F.col(f"__{c}") <= 1 for c in first}})
    return g.select(*key, *first, *mean, "repeats"), rules


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], *, required: list[str] | None = None) -> DataFrame:
    """Left join with a table of one row a key; a repeated key of that table, or a null in a required column of it, is an error."""
    n = F.count("*").over(Window.partitionBy(*on))
    named = F.concat_ws("|", *[F.col(c).cast("string") for c in on])
    r = right.withColumn("__n", n)
    r = r.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), named)).cast("boolean"))).drop("__n")
    j = left.join(r, on, "left")
    for c in required or []:
        j = j.where(F.when(F.col(c).isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"no {c} for "), named)).cast("boolean")))
    return j


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """rule, n: one row for each column, n = 1 if it is absent or the table is empty of it (all null)."""
    have = {c.lower() for c in df.columns}
    present = [c for c in names if c.lower() in have]
    filled = df.agg(*[(F.count(c) == 0).cast("long").alias(c) for c in present], F.lit(0).alias("__none"))
    rows = [F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) if c in present else F.struct(F.lit(c).alias("rule"), F.lit(1).cast("long").alias("n")) for c in names]
    return filled.select(F.inline(F.array(*rows)))


def physics(df: DataFrame, *, heavy: str, light: str, spins: list[str], ra: str, dec: str, total: str, parts: list[str], snr: str) -> DataFrame:
    """Physical ranges of a catalogue's rows: ordered masses, spins, angles, a total that is the sum of its parts, a signal."""
    added = parts and sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    rules = {
        "masses": C.finite(F.col(light)) & C.finite(F.col(heavy)) & (F.col(heavy) >= F.col(light)) & (F.col(light) > 0),
        **{s: C.finite(F.col(s)) & (F.abs(s) <= 1) for s in spins},
        "ra": (F.col(ra) >= 0) & (F.col(ra) < 6.283185307179586), "dec": F.abs(dec) <= 1.5707963267948966,
        "total": F.abs(F.col(total) - added) <= 1e-12 + 1e-8 * F.abs(added), "signal": F.col(snr) >= 0,
    }
    return counted(df, rules)
