"""Scores that arrive batch by batch, folded into what the metrics read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import metrics

TALLY = "g bigint, threshold double, correct boolean, chars bigint, split bigint, merged bigint, tp bigint, fp bigint, fn bigint, pairs bigint, version bigint, final boolean"


def streamed_pairs(edges: DataFrame) -> DataFrame:
    """(g, ca, cb, n_edges, prob, label) of a stream of scored edges: running maxima, the state is one row for each pair.

    Works on batch frames too. With update output each trigger emits the pairs that changed; with watermarked input give
    withWatermark before, so that old graphs' state goes.
    """
    rows = edges.where("ca <> cb").select("g", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "prob", "label")
    return rows.groupBy("g", "ca", "cb").agg(F.count("*").alias("n_edges"), F.max("prob").alias("prob"), F.max("label").alias("label"))


def windowed(edges: DataFrame, ts: str, window: str, late: str) -> DataFrame:
    """(start, edges, positives): scored edges by event-time window; rows later than late are dropped."""
    rows = edges.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("edges"), F.count_if("label").alias("positives"))
    return rows.select(F.col("w.start").alias("start"), "edges", "positives")


class GraphTally(StatefulProcessor):
    """The contours and pair maxima of one graph, and after each batch its tallies at all thresholds."""

    def __init__(self, thresholds: list[float], late_ms: int):
        self.thresholds, self.late_ms = thresholds, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getMapState("pairs", "ca bigint, cb bigint", "prob double, label boolean")
        self.contours = handle.getMapState("contours", "c bigint", "ch bigint")
        self.version = handle.getValueState("version", "n bigint")

    def _rows(self, key, final: bool) -> Iterator[pd.DataFrame]:
        n = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((n,))
        own = [(c[0], ch[0]) for c, ch in self.contours.iterator()]
        known = {c for c, _ in own}  # a pair may come before its contours
        links = sorted((a, b, p, label) for (a, b), (p, label) in self.pairs.iterator() if a in known and b in known)
        rows = [(key[0], *t, n, final) for t in metrics.tally(sorted(own, key=lambda x: x[0]), links, self.thresholds)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in TALLY.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        newest = timerValues.getCurrentWatermarkInMs() if self.late_ms else 0
        for part in rows:
            if self.late_ms:
                newest = max([newest, *part["ms"].dropna().astype(int)])
            for c, ch in part.loc[part["c"].notna(), ["c", "ch"]].itertuples(index=False):
                self.contours.updateValue((int(c),), (None if pd.isna(ch) else int(ch),))
            best: dict[tuple[int, int], tuple[float, bool]] = {}
            for a, b, p, label in part.loc[part["ca"].notna() & (part["ca"] != part["cb"]), ["ca", "cb", "prob", "label"]].itertuples(index=False):
                pair = (int(min(a, b)), int(max(a, b)))
                prob, known = best.get(pair, (float("-inf"), False))
                best[pair] = max(prob, float(p)), known or bool(label)
            for pair, (prob, known) in best.items():
                if self.pairs.containsKey(pair):
                    before = self.pairs.getValue(pair)
                    prob, known = max(prob, before[0]), known or before[1]
                self.pairs.updateValue(pair, (prob, known))
        if self.late_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(newest) + self.late_ms)
        yield from self._rows(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        yield from self._rows(key, True)
        for state in (self.pairs, self.contours, self.version):
            state.clear()

    def close(self) -> None:
        pass


def streamed_tallies(events: DataFrame, thresholds: list[float], ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """(TALLY): metrics.tallies of each graph of a stream, again after each batch that brings something of it.

    events has g and either a contour (c, ch) or a scored edge (ca, cb, prob, label), the others null, in any order and any
    batches; edges within a contour don't matter. The state of a graph is its contours and the maxima of its pairs. version
    counts up: of a graph and threshold the row of the largest is what a batch job would tell (latest). With ts, an event
    time, a graph is final once the watermark is late beyond its newest row: it gives its rows once more and its state goes.
    Use with the RocksDB state store.
    """
    late_ms = 0
    if ts:
        late_ms = int(pd.Timedelta(late).total_seconds() * 1000)
        events = events.withWatermark(ts, late)
    kinds = {"g": "bigint", "c": "bigint", "ch": "bigint", "ca": "bigint", "cb": "bigint", "prob": "double", "label": "boolean"}
    own = events.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], *([ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("ms")] if ts else []))
    return own.groupBy("g").transformWithStateInPandas(GraphTally(thresholds, late_ms), outputStructType=TALLY, outputMode="Update", timeMode="EventTime" if ts else "None")


def latest(rows: DataFrame) -> DataFrame:
    """Of each graph and threshold the tallies of the largest version, as metrics.summed takes them."""
    names = [c.split()[0] for c in TALLY.split(", ")]
    return rows.groupBy("g", "threshold").agg(F.max_by(F.struct(*names), "version").alias("r")).select("r.*").drop("version", "final")
