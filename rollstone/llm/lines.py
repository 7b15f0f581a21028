"""Problem 1: lines repeated across the documents of one source.

First pass: heavy-hitter summaries (Misra-Gries counters with their error) of source and line, mergeable in any order. Each
partition counts its own lines; summaries are merged by hash range, so that a source with a third of all rows is as spread as
any other, and counters are given up only while the error stays below the wanted count: no repeated line is lost.
Second pass: exact numbers of documents for the candidates. Candidates and confirmed lines are broadcast where Spark finds their bytes
below spark.sql.autoBroadcastJoinThreshold, and joined by shuffle otherwise; the plan is the same one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import durable, ship

#: Distinct documents of a source from which a line counts as repeated; counters of a summary.
LEAST, COUNTERS = 8, 1 << 16
#: Lines that a partition adds to its summary at once, and that the summary holds.
HELD = 1 << 20
_WHITE = "[ \\t\\r\\n\\f\\x0B\\u00A0]+"


def line_form(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.replace(c, F.lit("’"), F.lit("'")), _WHITE, " ")))


def source_form(c: str) -> Column:
    return F.lower(F.regexp_replace(F.col(c), f"^{_WHITE}|{_WHITE}$", ""))


class Summary:
    """Counters of the most frequent hashes; a hash's true count is at most its counter, or 0, plus error."""

    def __init__(self, least: int, counters: int = COUNTERS):
        self.least, self.counters, self.error = least, counters, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> Summary:
        self.keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, counts]), len(self.keys)).astype(np.int64)
        self.error += error
        if len(self.keys) > self.counters:
            cut = int(np.partition(self.counts, len(self.counts) - self.counters - 1)[len(self.counts) - self.counters - 1])
            if self.error + cut < self.least:  # else what was given up might be wanted
                self.error += cut
                kept = self.counts > cut
                self.keys, self.counts = self.keys[kept], self.counts[kept] - cut
        return self

    def candidates(self) -> np.ndarray:
        return self.keys[self.counts + self.error >= self.least]


def _hashed(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(id, lines): for each line in order two 64-bit hashes of source and line form, null for a blank line."""
    s = source_form(source)
    lines = F.transform(F.split(text, "\n"), lambda x: line_form(x))
    two = F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(s, x).alias("k"), F.xxhash64(F.lit(1), x, s).alias("k2"))))
    return df.where(F.col(key).isNotNull() & F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), two.alias("lines"))


def _candidates(base: DataFrame, least: int) -> DataFrame:
    total = base.agg(F.sum(F.size("lines"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / (2 * COUNTERS)))))  # so many lines in a range that the error stays below 2 or 3

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's summary, cut by ranges; it is sent and begun anew when it holds many lines."""
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        size = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            k, n = np.unique(np.concatenate([np.zeros(0, np.int64), *fresh]), return_counts=True)
            both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

        def send() -> pa.RecordBatch:
            part = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order], prepend=-1))
            offsets = pa.array([*cut, len(keys)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(part[order][cut]), *(pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (keys, counts))], ["part", "keys", "counts"])

        for b in batches:
            fresh.append(np.asarray(b.column(0).flatten().drop_null()))
            size += len(fresh[-1])
            if size >= HELD:
                keys, counts = added()
                fresh, size = [], 0
                if len(keys) >= HELD:
                    yield send()
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = added()
        if len(keys):
            yield send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Summary] = {}
        for b in batches:
            for i, part in enumerate(b.column(0).to_pylist()):
                held.setdefault(part, Summary(least)).merge(*(b.column(c)[i].values.to_numpy() for c in (1, 2)))
        for s in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(s.candidates())], ["k"])

    keys = base.select(F.col("lines.k").alias("k"))
    return keys.mapInArrow(summarise, "part bigint, keys array<bigint>, counts array<bigint>").repartition("part").mapInArrow(merge, "k bigint")


def _confirmed(base: DataFrame, least: int) -> DataFrame:
    candidates = durable(_candidates(base, least), "candidates")
    each = base.select("id", F.explode("lines").alias("line")).where("line IS NOT NULL").select("id", "line.*")
    each = each.join(candidates, "k", "left_semi")
    return durable(each.distinct().groupBy("k", "k2").agg(F.count("*").alias("ids")).where(F.col("ids") >= least), "confirmed")


def repeated_lines(df: DataFrame, key: str = "id", text: str = "text", source: str = "source", least: int = LEAST) -> DataFrame:
    """(key, line_no): the lines that stand in at least so many distinct keys of their source; distinct rows.

    Lines are cut at line feeds and counted from 0, blank lines included. A row with a null key, text or source has none.
    """
    base = durable(_hashed(df, key, text, source), "lines")
    confirmed = _confirmed(base, least)
    each = base.select("id", F.posexplode("lines").alias("line_no", "line")).where("line IS NOT NULL").select("id", "line_no", "line.*")
    return each.join(confirmed, ["k", "k2"], "left_semi").select(F.col("id").alias(key), "line_no").distinct()


def without_repeated_lines(df: DataFrame, key: str = "id", text: str = "text", source: str = "source", least: int = LEAST) -> DataFrame:
    """Every row of df: key, clean (the text without the repeated lines of its source) and removed (how many lines went).

    A null text stays null with 0 removed; a null source has nothing removed; a row with a null key loses its lines like any other. Rows delivered twice
    come out twice.
    """
    ship(df.sparkSession)
    confirmed = _confirmed(durable(_hashed(df, key, text, source), "lines"), least).select("k", "k2")
    # a row's own text and source say what it loses, whatever its key: lines are found again by both
    s = source_form(source)
    d = df.select(F.col(key), F.col(text).alias("_t"), F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_h2"), s.alias("_s"))
    own = ["_h", "_h2", "_s"]
    forms = F.transform(F.split("_t", "\n"), lambda x: line_form(x))
    each = d.where("_t IS NOT NULL AND _s IS NOT NULL").select(*own, F.posexplode(forms).alias("line_no", "form")).where("form <> ''")
    each = each.select(*own, "line_no", F.xxhash64("_s", "form").alias("k"), F.xxhash64(F.lit(1), "form", "_s").alias("k2"))
    found = each.join(confirmed, ["k", "k2"], "left_semi").groupBy(*own).agg(F.collect_set("line_no").alias("nos"))
    lines = F.split("_t", "\n")
    kept = F.filter(lines, lambda x, i: F.col("nos").isNull() | ~F.array_contains("nos", i))
    return d.join(found, own, "left").select(F.col(key), F.when(F.col("_t").isNotNull(), F.array_join(kept, "\n")).alias("clean"), F.when(F.col("_t").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).alias("removed"))
