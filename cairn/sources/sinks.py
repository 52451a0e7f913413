"""Writing snapshot files (Zstandard JSONL, ordered by digest bytes), exported bytes and summaries."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import digest
from cairn.sources.logs import digest_text


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def write_snapshot_files(lines: DataFrame, folder: str, files: int = 1, level: int = 14) -> DataFrame:
    """Writes (digest, line) as so many Zstandard files in ascending digest order, each digest once; returns (file, rows).

    The least line of a digest is kept. Files are range-partitioned, so their names' order is the digests' order. Each is
    written beside its place, flushed and renamed; a file that is there is never overwritten. folder must be a path
    that all executors share. Rows whose digest isn't one are refused.
    """
    path = _local(folder)

    def write(batches: Iterator) -> Iterator:
        import pandas as pd
        import zstandard
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        name, rows = f"{path}/part-{at:05d}.jsonl.zst", 0
        os.makedirs(path, exist_ok=True)
        waiting = f"{path}/.{at}-{uuid.uuid4().hex}.tmp"
        with open(waiting, "wb") as f:
            with zstandard.ZstdCompressor(level=level).stream_writer(f, closefd=False) as z:
                for b in batches:
                    for line in b["line"]:
                        z.write(line.encode() + b"\n")
                        rows += 1
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(waiting, name)
        except FileExistsError:
            with open(name, "rb") as a, open(waiting, "rb") as b:
                if a.read() != b.read():  # a repeated attempt writes the same bytes
                    raise
        finally:
            os.unlink(waiting)
        yield pd.DataFrame({"file": [name], "rows": [rows]})

    key = digest.order_key(F.col("digest"))
    sound = F.when(key.isNull(), F.raise_error(F.concat(F.lit("no digest: "), "digest")).cast("string")).otherwise(key)
    one = lines.groupBy("digest").agg(F.min("line").alias("line")).withColumn("key", sound)
    return one.repartitionByRange(files, "key").sortWithinPartitions("key").select("line").mapInPandas(write, "file string, rows bigint")


def export_bytes(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (digest, content) as files named by digest and reads each back: (digest, outcome ok, mismatch or exists)."""
    path = _local(folder)

    def write(batches: Iterator) -> Iterator:
        import pandas as pd

        os.makedirs(path, exist_ok=True)
        for b in batches:
            out = []
            for name, content in zip(b["digest"], b["content"]):
                at = f"{path}/{os.path.basename(name)}"
                data = content if isinstance(content, bytes) else str(content).encode()
                try:
                    with open(at, "xb") as f:
                        f.write(data)
                    there = "ok"
                except FileExistsError:
                    there = "exists"
                with open(at, "rb") as f:
                    found = digest_text(hashlib.sha1(f.read()).digest())
                out.append(there if found == name else "mismatch")
            yield pd.DataFrame({"digest": b["digest"], "outcome": out})

    return rows.select("digest", "content").mapInPandas(write, "digest string, outcome string")


def summary_json(counters: DataFrame) -> DataFrame:
    """One row of counters as one JSON text."""
    return counters.select(F.to_json(F.struct(*counters.columns)).alias("summary"))
