"""Structured Streaming forms: windowed counts, sessions, de-duplication, typestate, and scans of arriving sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts per tumbling window and key; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str = "ts", late: str = "10 minutes", gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def distinct_findings(found: DataFrame, time: str = "ts", late: str = "1 hour", keys: tuple[str, ...] = ("location", "line", "cwe")) -> DataFrame:
    """The first of equal findings that arrive within the watermark."""
    return found.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def near_findings(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("location", "type"), lines: int = 3, apart: str = "20 minutes", late: str = "30 minutes") -> DataFrame:
    """Pairs of findings of two streams, each with (keys, line, ts): equal keys, lines at most so far apart, times at most apart.
    With watermarks on both sides and a band on time the join drops from its state what no row to come can meet."""
    a = left.withWatermark("ts", late).select(*keys, "line", "ts").alias("a")
    b = right.withWatermark("ts", late).select(*keys, "line", "ts").alias("b")
    same = F.abs(F.col("a.line") - F.col("b.line")) <= lines
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    band = F.expr(f"b.ts >= a.ts - INTERVAL {apart} AND b.ts <= a.ts + INTERVAL {apart}")
    return a.join(b, same & band).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.line").alias("line"), F.col("b.line").alias("other_line"), F.col("a.ts").alias("ts"))


class LastOperation(StatefulProcessor):
    """State of a (proc, var): its last lifetime operation. Rows of a batch go by seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "op string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else ""
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, op in zip(batch.seq, batch.op, strict=True):
            if last == "free" and op in ("free", "use"):
                out.append((*key, seq, "CWE-415" if op == "free" else "CWE-416"))
            if op in ("alloc", "free"):
                last = op
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["proc", "var", "seq", "cwe"])

    def close(self) -> None:
        pass


def typestate(instructions: DataFrame) -> DataFrame:
    """(proc, var, seq, cwe) of frees and uses after a free. The state store must be RocksDB, which holds states beyond memory; the session is set to it."""
    instructions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return instructions.groupBy("proc", "var").transformWithStateInPandas(LastOperation(), "proc long, var int, seq int, cwe string", "append", "none")


def scan_arrivals(spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = "*.*") -> StreamingQuery:
    """Scans each source that arrives below path and appends its findings to out; a restart takes up at the checkpoint."""
    from ..scan.engine import scan

    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select(F.input_file_name().alias("filename"), F.col("value").alias("text"))
    return files.writeStream.foreachBatch(lambda batch, _: scan(batch).filter("error IS NULL").write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All that a stream has now, appended to a table."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
