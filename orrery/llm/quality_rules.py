"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document or abstains (0).  A
generative model holds that rule j, when it votes, is right on good documents
with one accuracy and on bad ones with another, independently of the other
rules given the document's quality.  Expectation-maximisation over the counts
of vote patterns (at most three to the power of the rules, whatever the corpus)
estimates the accuracies and the share of good documents from all documents;
the posterior probability of quality then replaces a filter that every rule
must pass.

Words are runs without ASCII white space.  Words in windows: each window of
eight words is hashed; hashes are sorted inside the row, equal neighbours mark
repeated windows, and the union of their spans is measured.

Votes are cast once and written with the ``keep`` columns alone, so a text is
written only if it is asked for.

Defined results: a null text has no words (all counts 0, failed); a text that
fails the base rules is never kept; an empty table gives an empty result; rows
repeated and rows of null id are judged each; a very long text is judged as a
whole, in one row.  Input columns may have any names: only the given text column
and those of ``keep`` are read, under names of the operator's own; ``keep`` may
not use the names of the added columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WHITE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
#: Share of good documents to start from and its range, weight of the start in pseudo-documents, and rounds.
SHARE, LEAST_SHARE, MOST_SHARE, PRIOR, ROUNDS = 0.85, 0.05, 0.98, 10.0, 15
#: A rule's accuracy on good and on bad documents: start, least, most.
ON_GOOD, ON_BAD = (0.97, 0.9, 0.998), (0.4, 0.1, 0.95)


def counts(rows: DataFrame) -> DataFrame:
    """From rows with __t (a text, not null): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, __lines, __upper, __letters and __distinct, in its place."""
    rest = [c for c in rows.columns if c != "__t"]
    out = rows.withColumn("__w", F.filter(F.split("__t", WHITE), lambda x: x != ""))
    out = out.withColumn("n_words", F.size("__w").cast("long")).withColumn("__x", F.transform("__w", lambda w: F.xxhash64(w)))
    hashes = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get("__x", i + k) for k in range(WINDOW)])))
    out = out.withColumn("__h", hashes).withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.select(
        *rest,
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").alias("__lines"),
        F.regexp_count("__t", F.lit("[A-Z]")).alias("__upper"),
        (F.length("__t") - F.regexp_count("__t", F.lit(r"\P{L}"))).alias("__letters"),
        F.size(F.array_distinct("__w")).alias("__distinct"),
        F.when(repeats, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"),
    )
    same = lambda x, j: ((j > 0) & (F.get("__s", j - 1)["h"] == x["h"])) | F.coalesce(F.get("__s", j + 1)["h"] == x["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("__s", same), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n"))
    covered = F.aggregate(places, start, step, lambda a: a["n"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__s")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "base_failed", "quality", "kept")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Each rule: name, SQL predicate of a bad vote, SQL predicate of a good vote, over the columns of ``counts``.
RULES = (
    ("length", "n_words < 20", "n_words >= 40"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("letters", "10 * __letters < 9 * word_chars", "100 * __letters >= 95 * word_chars"),
    ("repeats", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    ("lines", "10 * n_dup_lines > 3 * __lines", "n_dup_lines = 0 and __lines > 1"),
    ("shouting", "10 * __upper > 3 * word_chars", "10 * __upper <= word_chars"),
    ("variety", "n_words >= 40 and 10 * __distinct < n_words", "3 * __distinct > n_words"),
)


def votes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"__v_{name}": F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for name, bad, good in RULES})


def weights(share: float, good: float, bad: float) -> tuple[float, float]:
    """What a good vote and a bad vote add to the log-odds of quality."""
    return math.log(good / (1 - bad)), math.log((1 - good) / bad)


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """The share of good documents and each rule's two accuracies, by expectation-maximisation over (pattern, count)."""
    share, right = SHARE, [(ON_GOOD[0], ON_BAD[0])] * len(RULES)
    if not patterns:
        return share, right
    for _ in range(ROUNDS):
        adds = [dict(zip((1, -1), weights(share, *r), strict=True)) | {0: 0.0} for r in right]
        odds = math.log(share / (1 - share))
        good = [1 / (1 + math.exp(-(odds + sum(a[v] for v, a in zip(p, adds, strict=True))))) for p, _ in patterns]
        rows = [(p, c * g, c * (1 - g)) for g, (p, c) in zip(good, patterns, strict=True)]
        share = min(max(sum(g for _, g, _ in rows) / sum(c for _, c in patterns), LEAST_SHARE), MOST_SHARE)
        for j in range(len(RULES)):
            on = []
            for (start, least, most), k, says in ((ON_GOOD, 1, 1), (ON_BAD, 2, -1)):
                hit = sum(r[k] for r in rows if r[0][j] == says)
                cast = sum(r[k] for r in rows if r[0][j])
                on.append(min(max((hit + PRIOR * start) / (cast + PRIOR), least), most))
            right[j] = tuple(on)
    return share, right


def quality_rules(docs: DataFrame, *, text: str = "text", threshold: float = 0.5, keep: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` columns (all of ``docs`` but those that clash with the added ones), the counts, ``base_failed``, ``quality`` (posterior probability) and ``kept``."""
    keep = {c: F.col(c) for c in docs.columns if c not in ADDED} if keep is None else keep
    rows = docs.select(*[c.alias(f"__k{k}") for k, c in enumerate(keep.values())], F.coalesce(F.col(text), F.lit("")).alias("__t"))
    counted = staged(votes(counts(rows)), "quality")
    names = [f"__v_{r[0]}" for r in RULES]
    seen = counted.groupBy(*names).count().collect()  # at most a row a pattern of votes
    share, right = estimate(sorted((tuple(r[n] for n in names), r["count"]) for r in seen))
    odds = F.lit(math.log(share / (1 - share)))
    for n, r in zip(names, right, strict=True):
        yes, no = weights(share, *r)
        odds = odds + F.when(F.col(n) == 1, yes).when(F.col(n) == -1, no).otherwise(0.0)
    out = counted.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-odds)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    return out.select(*[F.col(f"__k{k}").alias(n) for k, n in enumerate(keep)], *ADDED)


def oracle() -> str:
    """The same in DuckDB SQL: the estimation is written out round by round."""
    names = [r[0] for r in RULES]
    case = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end as v_{n}" for n, bad, good in RULES)
    columns = ", ".join(f"v_{n}" for n in names)
    sql = f"""with a as (select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
    win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from a, unnest(range(1, len(w) - 6)) as u(i)),
    twice as (select doc_id, g from win group by all having count(*) > 1),
    hit as (select distinct doc_id, i + k as p from win join twice using (doc_id, g), range(0, 8) as r(k)),
    rep as (select doc_id, count(*) as n from hit group by doc_id),
    c as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
      coalesce(n, 0)::bigint as n_repeat_words, len(l) as __lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as __upper, length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')) as __letters, len(list_distinct(w)) as __distinct
      from a left join rep using (doc_id)),
    v as (select *, {case} from c),
    p as (select {columns}, count(*) as n from v group by all),
    m0 as (select {SHARE}::double as share, {", ".join(f"{ON_GOOD[0]}::double as g_{n}, {ON_BAD[0]}::double as b_{n}" for n in names)})"""
    good = "1 / (1 + exp(-(ln(share / (1 - share)) + " + " + ".join(f"case v_{n} when 1 then ln(g_{n} / (1 - b_{n})) when -1 then ln((1 - g_{n}) / b_{n}) else 0 end" for n in names) + ")))"
    rate = lambda x, of, says, n: f"least(greatest((sum(case when v_{n} = {says} then {of} else 0 end) + {PRIOR * x[0]}) / (sum(case when v_{n} <> 0 then {of} else 0 end) + {PRIOR}), {x[1]}), {x[2]})"
    rates = ", ".join(f"{rate(ON_GOOD, 'n * g', 1, n)} as g_{n}, {rate(ON_BAD, 'n * (1 - g)', -1, n)} as b_{n}" for n in names)
    for k in range(ROUNDS):
        sql += f""", e{k} as materialized (select p.*, {good} as g from p, m{k}),
    m{k + 1} as materialized (select least(greatest(sum(g * n) / sum(n), {LEAST_SHARE}), {MOST_SHARE}) as share, {rates} from e{k})"""
    return sql + f""" select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and g >= 0.5 as kept
    from (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 30 * n_words as base_failed, {good} as g from v, m{ROUNDS})"""
