"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_sessions(obs: DataFrame, *, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Gap-based merging of (object, band, ts, flux, error) with mergeable sums; closed sessions are emitted."""
    w = F.lit(1.0) / (F.col("error") * F.col("error"))
    good = obs.where("error > 0 and not isnan(flux)").withWatermark("ts", late)
    g = good.groupBy("object", "band", F.session_window("ts", gap).alias("s")).agg(F.sum(w).alias("w"), F.sum(w * F.col("flux")).alias("wf"), F.count("*").alias("merged"))
    return g.select("object", "band", F.col("s.start").alias("start"), (F.col("wf") / F.col("w")).alias("flux"), (F.lit(1.0) / F.sqrt("w")).alias("error"), "merged")


def windowed(obs: DataFrame, *, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and mean flux of each band in tumbling or sliding windows."""
    return obs.withWatermark("ts", late).groupBy(F.window("ts", length, slide or length).alias("w"), "band").agg(F.count("*").alias("n"), F.avg("flux").alias("mean")).select("band", F.col("w.start").alias("start"), "n", "mean")


def candidates(anchors: DataFrame, events: DataFrame, *, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Stream-stream join of anchors (anchor, ats) with events (event_id, ts) within [ats, ats + window]."""
    a, e = anchors.withWatermark("ats", late), events.withWatermark("ts", late)
    return a.join(e, F.expr(f"ts >= ats and ts <= ats + interval {window}"))


def latest_status(status: DataFrame, path: str, *, key: str, by: str):
    """A foreachBatch writer that keeps the latest row of each key as Parquet versions under ``path``.

    Each batch reads the version before and writes its own, so a repeated batch gives the same table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            batch = batch.unionByName(spark.read.parquet(f"{path}/v{number - 1}"))
        except Exception as e:
            if number or "PATH_NOT_FOUND" not in str(e):
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        rest = [c for c in batch.columns if c not in (key, by)]
        last = batch.groupBy(key).agg(F.max(F.struct(by, *rest)).alias("r"))
        last.select(key, *[F.col(f"r.{c}").alias(c) for c in (by, *rest)]).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{number}")

    return status.writeStream.foreachBatch(write)


def kth_detection(obs: DataFrame, k: int, *, threshold: float = 5.0, late: str = "1 day", keep_days: float = 30.0) -> DataFrame:
    """(object, ts) when an object's k-th detection arrives: state is one counter an object.

    An object's state goes ``keep_days`` after its last row, by the watermark; a later row begins anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        found = []
        if state.hasTimedOut:
            state.remove()
        else:
            n, last = state.get if state.exists else (0, 0)
            for pdf in batches:
                last = max(last, int(pdf.ts.max().timestamp() * 1000))
                for ts in pdf[(pdf.error > 0) & (pdf.flux / pdf.error > threshold)].sort_values("ts").ts:
                    n += 1
                    if n == k:
                        found.append({"object": key[0], "ts": ts})
            state.update((n, last))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(keep_days * 86_400_000))
        yield pd.DataFrame(found, columns=["object", "ts"])

    return obs.withWatermark("ts", late).groupBy("object").applyInPandasWithState(step, "object long, ts timestamp", "n int, last long", "append", "EventTimeTimeout")
