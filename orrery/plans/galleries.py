"""Gallery queries: users are parent events, their views and purchases curves, errors the other kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import galleries as G
from ..operators import metrics as M
from .tables import load

SIZES, SHARE, TRIALS = [3, 5, 9], 0.5, 2
H = lambda key: f"('0x' || substr(sha256({key}), 1, 8))::bigint"


def kin(spark, d):
    e = load(spark, d, "events")
    return e.where("event_type in ('view', 'purchase')").select(F.col("user_id").alias("parent"), F.col("event_id").alias("row")), e.where("event_type = 'error'").select(F.col("event_id").alias("row"))


def positives(spark, d):
    k, _ = kin(spark, d)
    return G.random_positive(k.withColumnRenamed("parent", "query"), query="query", row="row", n_trials=TRIALS, seed="pos")


def galleries(spark, d):
    k, o = kin(spark, d)
    return G.mixed(positives(spark, d), k, o, sizes=SIZES, share=SHARE, n_trials=TRIALS, seed="mix")


def faults(spark, d):
    k, _ = kin(spark, d)
    return G.gallery_faults(galleries(spark, d), k)


def fixed(spark, d):
    """Nine candidates of every twentieth vector, in steps of 37 ids; the first of them counts as the positive."""
    e = load(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = e.agg(F.count("*").alias("n"))
    q = e.where("vec_id % 20 = 0").join(F.broadcast(n))  # one row
    g = q.select(F.col("vec_id").alias("query"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("slot"), "n").select("query", "slot", ((F.col("query") + 37 * F.col("slot")) % F.col("n")).alias("row"))
    dot = F.round(F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 9)
    s = G.scored(g, e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql"), F.col("v").alias("qv")), e.withColumnRenamed("vec_id", "row"), dot)
    return s.withColumn("is_positive", F.col("slot") == 1)


def scores(spark, d):
    return fixed(spark, d).select("query", "slot", "row", F.round("score", 6).alias("score"))


def outcomes(spark, d):
    s = fixed(spark, d)
    ranks = M.expected_rank(s, by=["query"]).select("query", "above", "tied")
    return G.enriched(ranks, s.withColumn("source", F.col("ql")), ["query"], ["source"])


def conditional(spark, d):
    s = fixed(spark, d)
    out = G.conditional_metrics(s, by=["query"], conditions={"same_label": F.col("label") == F.col("ql"), "even": F.col("row") % 2 == 0})
    return out.select("condition", "n", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_5", "mrr")])


def hard_negative(spark, d):
    s = fixed(spark, d).where("not is_positive").withColumn("dt", (F.col("row") % 11 - 5).cast("double"))
    return G.windowed_hard_negative(s, by=["query"], dt="dt", score="score", row="row", lo=-1.0, hi=2.0)


def lexsorted(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", (F.floor("value") % 7 - 3).alias("dt"), (F.col("event_id") % 4).alias("level"))
    return G.by_time_then_level(e, 4, by=["user_id"], dt="dt", level="level", key="event_id", seed="lex").select("user_id", "event_id", "slot")


def distractors(spark, d):
    """Galleries of 2, 4 and 8 with random distractors of any kind: the order of the pool, from a hashed start."""
    k, o = kin(spark, d)
    pool = G.hashed_order(o, "row", n_trials=1, seed="distract")
    total = pool.groupBy("trial").agg(F.max("total").alias("total"))
    q = k.select(F.col("parent").alias("query")).distinct().withColumn("trial", F.lit(0)).join(F.broadcast(total), "trial")  # one row
    q = q.withColumn("position", C.hash32(C.key_of("distract-start", F.col("query"))) % F.col("total"))
    w = G.walk(q, pool, 7, key="row", name="row").withColumn("size", F.explode(F.array(F.lit(2), F.lit(4), F.lit(8)))).where("slot <= size - 1")
    return w.select("query", "size", "slot", "row")


def digests(spark, d):
    return G.identity(galleries(spark, d), ["trial", "query", "size"], ["slot"], "row")


def attributes(spark, d):
    """Line items with their supplier's nation and name, looked up by key; unknown keys would be an error."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return G.with_attributes(li, s, ["l_suppkey"]).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_distinct("s_name").alias("suppliers"))


KIN_SQL = "kin as (select user_id as parent, event_id as row from events where event_type in ('view', 'purchase')), oth as (select event_id as row from events where event_type = 'error')"
POS_SQL = f"{KIN_SQL}, pos as (select trial, parent as query, row from (select trial, parent, row, row_number() over (partition by trial, parent order by {H(repr('pos|') + ' || trial || ' + repr('|') + ' || row')}, row) as k from kin, range(0, {TRIALS}) as t(trial)) where k = 1)"
KEY = lambda seed, col: H(f"'{seed}|' || trial || '|' || {col}")
MIX_SQL = f"""{POS_SQL}, par as (select trial, parent, row_number() over (partition by trial order by {KEY('mix-parent', 'parent')}, parent) - 1 as p, count(*) over (partition by trial) as n from (select distinct parent from kin), range(0, {TRIALS}) as t(trial)),
one as (select trial, parent, row from (select trial, parent, row, row_number() over (partition by trial, parent order by {KEY('mix-row', 'row')}, row) as k from kin, range(0, {TRIALS}) as t(trial)) where k = 1),
pool as (select trial, row, row_number() over (partition by trial order by {KEY('mix-other', 'row')}, row) - 1 as p, count(*) over (partition by trial) as n from oth, range(0, {TRIALS}) as t(trial)),
sz as (select size, least(greatest(floor((size - 1) * {SHARE} + 0.5), 1), size - 2)::int as nk from (values {', '.join(f'({s})' for s in SIZES)}) as v(size)),
rel as (select pos.trial, pos.query, slot, one.row from pos join par a on a.trial = pos.trial and a.parent = pos.query, range(1, 9) as r(slot) join par b on b.trial = a.trial and b.p = (a.p + slot) % a.n join one on one.trial = b.trial and one.parent = b.parent where b.parent <> pos.query),
str as (select pos.trial, pos.query, slot, pool.row from pos, range(1, 9) as r(slot) join pool on pool.trial = pos.trial and pool.p = ({H("'mix-start|' || pos.trial || '|' || pos.query")} % (select count(*) from oth) + slot) % pool.n),
g as (select trial, query, size, 0 as slot, 'positive' as kind, row from pos, sz union all select trial, query, size, slot, 'kin', row from rel, sz where slot <= nk union all select trial, query, size, slot + nk, 'other', row from str, sz where slot <= size - 1 - nk)"""
FIX_SQL = """e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), n as (select count(*) as n from embeddings),
f as (select q.vec_id as query, slot, c.vec_id as row, q.label as ql, c.label, round(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 9) as score from e q, n, range(1, 10) as r(slot) join e c on c.vec_id = (q.vec_id + 37 * slot) % n where q.vec_id % 20 = 0)"""

QUERIES = {
    "gal_random_positive": (positives, f"with {POS_SQL} select trial::int as trial, query, row from pos"),
    "gal_mixed": (galleries, f"with {MIX_SQL} select trial::int as trial, query, size, slot::int as slot, kind, row from g"),
    "gal_mixed_faults": (
        faults,
        f"""with {MIX_SQL}, j as (select g.*, kin.parent from g left join kin using (row)), x as (select trial, query, size, count(*) as n, count(*) filter (kind = 'kin' and parent = query) as own, count(*) filter (kind = 'kin') - count(distinct case when kind = 'kin' then parent end) as twice, count(*) - count(distinct row) as rep from j group by all)
        select count(*) filter (own > 0) as own_parent, count(*) filter (twice > 0) as parent_twice, count(*) filter (rep > 0) as row_twice, count(*) filter (n < size) as undersized, count(*) as galleries from x""",
    ),
    "gal_identity": (digests, f"with {MIX_SQL} select trial::int as trial, query, size, sha256(string_agg(row::varchar, ',' order by slot)) as digest from g group by all"),
    "gal_scores": (scores, f"with {FIX_SQL} select query, slot::int as slot, row, round(score, 6) as score from f"),
    "gal_outcomes": (
        outcomes,
        f"with {FIX_SQL}, p as (select query, score as top from f where slot = 1) select query, count(*) filter (slot > 1 and score > top) as above, count(*) filter (slot > 1 and score = top) as tied, any_value(ql) as source, count(*) as actual_size from f join p using (query) group by query",
    ),
    "gal_conditional_metrics": (
        conditional,
        f"""with {FIX_SQL}, p as (select query, score as top, label = ql as same, row % 2 = 0 as even from f where slot = 1), r as (select query, count(*) filter (slot > 1 and score > top) + 1 as rank, any_value(same) as same, any_value(even) as even from f join p using (query) group by query),
        c as (select 'all' as condition, rank from r union all select 'same_label', rank from r where same union all select 'even', rank from r where even)
        select condition, count(*) as n, round(avg((rank <= 1)::int), 6) as recall_at_1, round(avg((rank <= 5)::int), 6) as recall_at_5, round(avg(1.0::double / rank), 6) as mrr from c group by 1""",
    ),
    "gal_windowed_hard_negative": (
        hard_negative,
        f"with {FIX_SQL}, x as (select *, row % 11 - 5 as dt from f where slot > 1) select query, coalesce(arg_max(row, (score, -row)) filter (dt between -1 and 2), arg_max(row, (score, -row))) as row, count(*) filter (dt between -1 and 2) > 0 as in_window from x group by query",
    ),
    "gal_lexsort": (
        lexsorted,
        f"with x as (select user_id, event_id, row_number() over (partition by user_id order by abs(floor(value)::bigint % 7 - 3), event_id % 4, {H(repr('lex|') + ' || event_id')}, event_id)::int as slot from events) select * from x where slot <= 4",
    ),
    "gal_distractors": (
        distractors,
        f"""with {KIN_SQL}, pool as (select row, row_number() over (order by {H("'distract|0|' || row")}, row) - 1 as p, count(*) over () as n from oth), q as (select distinct parent as query from kin)
        select query, size, slot::int as slot, pool.row from q, range(1, 8) as r(slot), (values (2), (4), (8)) as v(size) join pool on pool.p = ({H("'distract-start|' || query")} % (select count(*) from oth) + slot) % pool.n where slot <= size - 1""",
    ),
    "gal_pair_lookup": (attributes, "select s_nationkey, count(*) as n, count(distinct s_name) as suppliers from lineitem join supplier on l_suppkey = s_suppkey group by 1"),
}
