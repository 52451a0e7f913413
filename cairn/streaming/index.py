"""Structured Streaming: index rows into an upserted table, claims that run out, and logs that keep first observations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.archive import upsert
from cairn.session import file_system


def fill_index(rows: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 256) -> StreamingQuery:
    """Keeps the last row per key of a stream of index rows in a table of buckets by key hash.

    Each micro-batch reads and writes only the buckets that its keys fall into; a small manifest per batch, put in place
    last, says in which batch each bucket was written. A batch that is run again after a failure does the same again,
    so a batch counts once. buckets counts for a new table. The caller awaits or stops the query.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        n, written = _manifest(spark, table, number - 1) or (buckets, {})
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("bucket")
        batch.persist()
        touched = sorted(r.bucket for r in batch.select(bucket).distinct().collect())  # as many as buckets at most
        old = _read(spark, table, {b: v for b, v in written.items() if b in touched})
        merged = batch if old is None else old.unionByName(batch)
        out = upsert(merged.select("*", *[F.col(c).alias(f"_{c}") for c in order]), keys, [F.col(f"_{c}") for c in order])
        if touched:
            out.select(*batch.columns, bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/{number}")
        batch.unpersist()
        _put(spark, f"{table}/manifest/{number}", json.dumps([n, {**written, **dict.fromkeys(touched, number)}]))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, final = file_system(spark, path)
    folder, _, name = path.rpartition("/")
    _, waiting = file_system(spark, f"{folder}/.{name}.tmp")
    out = fs.create(waiting, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(waiting, final):
        raise OSError(f"{path} can't be put in place")


def _manifest(spark: SparkSession, table: str, number: int | None) -> tuple[int, dict[int, int]] | None:
    """(buckets, the batch that wrote each) after a batch, or after the last for None."""
    fs, at = file_system(spark, f"{table}/manifest")
    if not fs.exists(at):
        return None
    done = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()]
    done = [n for n in done if number is None or n <= number]
    if not done:
        return None
    n, written = json.loads(spark.read.text(f"{table}/manifest/{max(done)}").first().value)
    return n, {int(b): v for b, v in written.items()}


def _read(spark: SparkSession, table: str, written: dict[int, int]) -> DataFrame | None:
    paths = [f"{table}/data/{v}/bucket={b}" for b, v in sorted(written.items())]
    return spark.read.parquet(*paths) if paths else None


def index_version(spark: SparkSession, table: str, number: int | None = None) -> DataFrame | None:
    """The table after a batch, after the last for None; None if there is none."""
    known = _manifest(spark, table, number)
    return _read(spark, table, known[1]) if known else None


LEASE = "key string, status string, timeout bigint"


def leases(events: DataFrame) -> DataFrame:
    """The state of each key after its events (key, at seconds, action claim, done or release, seconds of the claim).

    A claim lasts until at + seconds, blindly replacing another; it is available again afterwards, by the watermark-free
    clock of the events themselves: each update tells the status at the key's latest event. done stays until released.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, timeout, clock = state.get if state.exists else ("available", None, None)
        for row in pd.concat(batches).sort_values("at", kind="stable").itertuples():
            clock = int(row.at)
            if row.action == "claim":
                status, timeout = "in_progress", clock + int(row.seconds)
            elif row.action == "done":
                status, timeout = "done", None
            else:
                status, timeout = "available", None
        if status == "in_progress" and timeout <= clock:
            status, timeout = "available", None
        state.update((status, timeout, clock))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "timeout": pd.array([timeout], dtype="Int64")})

    return events.groupBy("key").applyInPandasWithState(run, LEASE, "status string, timeout bigint, clock bigint", "update", GroupStateTimeout.NoTimeout)


def first_observations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of a stream of log entries only the first of each key (unbounded state: keys are never forgotten)."""
    return rows.dropDuplicates(key)


def windowed_counts(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts per time window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")
