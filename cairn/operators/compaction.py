"""Very many small files of records into few well-sized ones: incremental size-tiered compaction with a journal.

New small files of similar size are merged into a run, runs of similar size into larger runs, level by level, once there are
enough of them; other runs stay untouched, so that a call rewrites what is of the size of its input, not the store. Runs
hold disjoint records: a record that the store has is not written again. Should it turn up at an earlier place (a late
file with a smaller id), a moved row with that place is written, which takes precedence when the store is read and is
folded into the record when both are merged.

Each step is a transaction: its output is written to a folder named after its inputs, and only then is one journal file,
with inputs and outputs, put in place by an atomic rename. What the journal has is done and isn't done again; what it
lacks never happened, and its remains are overwritten by the next attempt or never read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import defaultdict
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import jsontext
from cairn.session import file_system

BASE_BYTES = 1024
FANOUT = 8
TARGET_BYTES = 128 << 20
#: Records of a call up to which their keys are broadcast to look them up in the store.
MOST_BROADCAST = 200_000
RECORD = "record string, file_id bigint, line_no int, line string"
RUN = f"{RECORD}, moved boolean"


def record_key(line: Column) -> Column:
    """A key that agrees for lines with the same record (clean digest, JSON value of content); null for incomplete lines.

    Complete is a line that is one strict JSON object with members digest and content; its other members don't count.
    """

    @F.pandas_udf("string")
    def of(lines: pd.Series) -> pd.Series:
        keys: list[str | None] = []
        for line in lines:
            key = None
            if isinstance(line, str) and line.lstrip(" \t\r")[:1] == "{":
                try:
                    value = jsontext.parse(line)
                except ValueError:
                    value = None
                if type(value) is dict and "digest" in value and "content" in value:
                    d = value["digest"]
                    d = d.strip().upper().removeprefix("SHA1:") if type(d) is str else jsontext.canonical(d) + " isn't text"
                    key = hashlib.sha256(f"{jsontext.storable(d)}\0{jsontext.canonical(value['content'], False)}".encode()).hexdigest()[:40]
            keys.append(key)
        return pd.Series(keys, dtype=object)

    return of(line)


def tier_of(size: Column) -> Column:
    """The power of FANOUT, from BASE_BYTES, that a size reaches; sizes of one tier are similar. Null counts as 0."""
    return F.greatest(F.lit(0), F.floor(F.log(F.greatest(F.coalesce(size, F.lit(0)), F.lit(1)) / BASE_BYTES) / math.log(FANOUT)) + 1).cast("int")


def records(files: DataFrame, file_id: str, size: str, body: str) -> DataFrame:
    """The complete records of all files: record (key), tier (of the file), file_id, line_no, line.

    Lines end with LF, a CR before it is dropped, and line_no counts all lines from 1. Null and empty bodies have none.
    """
    lines = files.select(tier_of(files[size]).alias("tier"), files[file_id].cast("bigint").alias("file_id"), F.posexplode(F.split(files[body], "\n")).alias("at", "raw"))
    lines = lines.select("tier", "file_id", (F.col("at") + 1).alias("line_no"), F.regexp_replace("raw", r"\r\z", "").alias("line")).where(F.col("line") != "")
    return lines.withColumn("record", record_key(F.col("line"))).where(F.col("record").isNotNull()).select("record", "tier", "file_id", "line_no", "line")


def first_places(rows: DataFrame, *more: Column) -> DataFrame:
    """One row per record: the least by (file_id, line_no). Partial aggregation keeps repeated records out of the shuffle."""
    best = F.min(F.struct("file_id", "line_no", "line", *[c for c in rows.columns if c == "tier"])).alias("best")
    return rows.groupBy("record").agg(best, *more).select("record", "best.*", *[c for c in ("moved",) if more])


@dataclass(frozen=True)
class Entry:
    """One run that a transaction wrote: from which runs, or, at level 0, from how many files and of which range of ids."""

    run: str
    txn: str
    level: int
    inputs: tuple[str, ...]
    output: str
    size: int
    rows: int
    moved: int = 0
    files: int = 0
    least_file: int = 0
    last_file: int = -1


class Journal:
    """The committed transactions of a store, one small JSON file each, in the store's folder 'journal'.

    Read once and kept up to date by its own commits: a store has one writer at a time.
    """

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store, self.folder = spark, store, f"{store}/journal"
        self._entries: dict[str, Entry] = {}
        for r in self.spark.read.text(names).collect() if (names := self._files()) else []:  # a small line per transaction since the last snapshot
            for e in json.loads(r.value):
                self._entries[e["run"]] = Entry(**(e | {"inputs": tuple(e["inputs"])}))

    def _files(self) -> list[str]:
        fs, at = file_system(self.spark, self.folder)
        return sorted(str(s.getPath()) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def _put(self, name: str, entries: list[Entry]) -> None:
        fs, final = file_system(self.spark, f"{self.folder}/{name}.json")
        if fs.exists(final):
            return
        _, waiting = file_system(self.spark, f"{self.folder}/.{name}.tmp")
        out = fs.create(waiting, True)
        out.write(bytearray(json.dumps([asdict(e) for e in entries]).encode()))
        out.close()
        if not fs.rename(waiting, final):
            raise OSError(f"journal file {name} can't be put in place")

    def entries(self) -> dict[str, Entry]:
        return dict(self._entries)

    def commit(self, txn: str, entries: list[Entry]) -> None:
        """All runs of a transaction at once."""
        self._put(txn, entries)
        self._entries |= {e.run: e for e in entries}

    def live(self) -> list[Entry]:
        """The runs that no other transaction has merged."""
        merged = {i for e in self._entries.values() for i in e.inputs}
        return sorted((e for e in self._entries.values() if e.run not in merged), key=lambda e: (e.size, e.run))

    def shorten(self) -> None:
        """Replaces all journal files by one with what still counts: live runs, and level 0, which knows the files taken."""
        old = self._files()
        live = {e.run for e in self.live()}
        kept = [e if e.level == 0 or e.run not in live else replace(e, inputs=()) for e in self._entries.values() if e.run in live or e.level == 0]
        gone = {e.run for e in kept if e.level == 0 and e.run not in live}
        if gone and live:  # merged runs of level 0 stay marked as merged
            first = next(i for i, e in enumerate(kept) if e.run in live)
            kept[first] = replace(kept[first], inputs=tuple(sorted(gone)))
        name = "snapshot-" + hashlib.sha256(json.dumps([old, sorted(live)]).encode()).hexdigest()[:24]
        self._put(name, kept)
        for path in old:
            if not path.endswith(f"/{name}.json"):
                fs, at = file_system(self.spark, path)
                fs.delete(at, False)
        self._entries = {e.run: e for e in kept}


def _size(spark: SparkSession, path: str) -> int:
    fs, at = file_system(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def _txn(level: int, *parts: object) -> str:
    return f"{level}-" + hashlib.sha256(json.dumps([level, *parts]).encode()).hexdigest()[:24]


def _runs(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    paths = [e.output for e in entries if e.rows + e.moved]
    return spark.read.schema(RUN).parquet(*paths) if paths else spark.createDataFrame([], RUN)


def _not_taken(slim: DataFrame, journal: Journal) -> DataFrame:
    """The files that no transaction has read. Only lists of files whose range of ids meets the new files' are looked at."""
    if not any(e.level == 0 for e in journal.entries().values()):
        return slim
    ends = slim.agg(F.min("file_id"), F.max("file_id")).first()
    lists = sorted({f"{journal.store}/inputs/{e.txn}" for e in journal.entries().values() if e.level == 0 and ends[0] is not None and e.least_file <= ends[1] and ends[0] <= e.last_file})
    return slim.join(slim.sparkSession.read.schema("file_id bigint").parquet(*lists), "file_id", "left_anti") if lists else slim


def _unknown(found: DataFrame, live: list[Entry]) -> DataFrame:
    """found, with moved: without records that the store has, those at an earlier place than the store's as moved rows."""
    if not sum(e.rows for e in live):
        return found.withColumn("moved", F.lit(False))
    stored = _runs(found.sparkSession, live).select("record", F.struct("file_id", "line_no").alias("at"))
    if found.count() <= MOST_BROADCAST:  # the store's keys are then read in place, not shuffled
        stored = stored.join(F.broadcast(found.select("record")), "record", "left_semi")
    places = stored.groupBy("record").agg(F.min("at").alias("at"))
    held = found.join(places, "record", "left").where(F.col("at").isNull() | (F.struct("file_id", "line_no") < F.col("at")))
    return held.withColumn("moved", F.col("at").isNotNull()).drop("at")


def merge_files(files: DataFrame, store: str, journal: Journal, target_bytes: int = TARGET_BYTES, file_id: str = "file_id", size: str = "size_bytes", body: str = "body") -> None:
    """Level 0: the small files that the journal doesn't know yet become one run per size tier, in one transaction."""
    spark = files.sparkSession
    slim = files.select(files[file_id].cast("bigint").alias("file_id"), files[size].cast("bigint").alias("size"), files[body].cast("string").alias("body"))
    slim = _not_taken(slim.where("file_id is not null"), journal)
    marks = slim.groupBy(tier_of(F.col("size")).alias("tier")).agg(F.count("*").alias("files"), F.bit_xor(F.xxhash64("file_id", "size")).alias("mark"), F.sum(F.hash("file_id").cast("bigint")).alias("sum"), F.sum("size").alias("bytes"), F.min("file_id").alias("least"), F.max("file_id").alias("last"))
    tiers = sorted((tuple(r) for r in marks.collect()), key=lambda t: t[0])  # one row per power of FANOUT
    if not tiers:
        return
    live = journal.live()
    txn = _txn(0, [t[:4] for t in tiers], [e.run for e in live])
    slim.select("file_id").coalesce(max(1, sum(t[1] for t in tiers) // 4_000_000)).write.mode("overwrite").parquet(f"{store}/inputs/{txn}")
    found = first_places(records(slim, "file_id", "size", "body"))
    if live:
        found.write.mode("overwrite").parquet(f"{store}/staged/{txn}")
        found = spark.read.schema(f"{RECORD}, tier int").parquet(f"{store}/staged/{txn}")
    parts = {t[0]: max(1, math.ceil((t[4] or 0) / target_bytes)) for t in tiers}
    part = F.pmod(F.xxhash64("record"), F.element_at(F.create_map(*[F.lit(x) for p in parts.items() for x in p]), F.col("tier")))
    placed = _unknown(found, live).repartition(sum(parts.values()), "tier", part)
    placed.write.mode("overwrite").partitionBy("tier").parquet(f"{store}/data/{txn}")
    held = {r.tier: r for r in spark.read.schema(f"{RUN}, tier int").parquet(f"{store}/data/{txn}").groupBy("tier").agg(F.count_if(~F.col("moved")).alias("rows"), F.count_if("moved").alias("moved")).collect()}
    entries = []
    for t, n, _, _, _, least, last in tiers:
        path = f"{store}/data/{txn}/tier={t}"
        entries.append(Entry(f"{txn}-{t}", txn, 0, (), path, _size(spark, path), held[t].rows if t in held else 0, held[t].moved if t in held else 0, n, least, last))
    journal.commit(txn, entries)
    fs, staged = file_system(spark, f"{store}/staged/{txn}")
    fs.delete(staged, True)


def merge_runs(spark: SparkSession, store: str, entries: list[Entry], journal: Journal, target_bytes: int = TARGET_BYTES) -> Entry:
    """One transaction: runs into one run of files of about target_bytes, each record once."""
    level, inputs = 1 + max(e.level for e in entries), tuple(sorted(e.run for e in entries))
    txn = _txn(level, inputs)
    path = f"{store}/data/{txn}"
    merged = _runs(spark, entries)
    if any(e.moved for e in entries):
        merged = first_places(merged, F.bool_and("moved").alias("moved"))
    merged.coalesce(max(1, math.ceil(sum(e.size for e in entries) / target_bytes))).write.mode("overwrite").parquet(path)
    held = spark.read.schema(RUN).parquet(path).agg(F.count_if(~F.col("moved")).alias("rows"), F.count_if("moved").alias("moved")).first()
    entry = Entry(txn, txn, level, inputs, path, _size(spark, path), held.rows, held.moved)
    journal.commit(txn, [entry])
    return entry


def content(spark: SparkSession, live: list[Entry]) -> DataFrame:
    """The records of a store: record, file_id, line_no, line, each once, at its first place."""
    runs = _runs(spark, live)
    kept = runs.where("not moved").select("record", "file_id", "line_no", "line")
    if not any(e.moved for e in live):
        return kept
    moved = runs.where("moved").groupBy("record").agg(F.min(F.struct("file_id", "line_no", "line")).alias("other"))
    if sum(e.moved for e in live) <= MOST_BROADCAST:
        moved = F.broadcast(moved)
    best = F.least(F.struct("file_id", "line_no", "line"), F.coalesce("other", F.struct("file_id", "line_no", "line")))
    return kept.join(moved, "record", "left").select("record", best.alias("best")).select("record", "best.*")


def compact(files: DataFrame, store: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, **columns: str) -> DataFrame:
    """Merges files into the store and returns its content: record, file_id, line_no, line, each record once.

    A call with files that the store has taken before does nothing for them; a call after a broken one goes on where that
    one stopped. Which files are new, their tiers and all merges are found from the files' metadata and the journal.
    As long as fanout runs or more are of similar size, they are merged into one; all other runs stay as they are. Files
    are of about target_bytes (of text at level 0, of stored bytes above). An empty table gives an empty store. Nulls in
    the body count as an empty file, rows without a file id are left out. Records of all new files are looked up in the
    store by key, for which the store's keys and places are read but not its lines.
    """
    spark, journal = files.sparkSession, Journal(files.sparkSession, store)
    merge_files(files, store, journal, target_bytes, **columns)
    while True:
        tiers: dict[int, list[Entry]] = defaultdict(list)
        for e in journal.live():
            tiers[0 if e.size <= BASE_BYTES else 1 + int(math.log(e.size / BASE_BYTES, fanout))].append(e)
        crowded = [t for t in sorted(tiers) if len(tiers[t]) >= fanout]
        if not crowded:
            return content(spark, journal.live())
        merge_runs(spark, store, tiers[crowded[0]], journal, target_bytes)


def clean_up(spark: SparkSession, store: str) -> list[str]:
    """Removes merged runs and the remains of broken transactions, and shortens the journal; returns the runs removed."""
    journal = Journal(spark, store)
    known = {e.txn for e in journal.entries().values()}
    for kind in ("data", "staged", "inputs"):
        fs, at = file_system(spark, f"{store}/{kind}")
        for status in fs.listStatus(at) if fs.exists(at) else []:
            if status.getPath().getName() not in known:
                fs.delete(status.getPath(), True)
    live = {e.run for e in journal.live()}
    gone = []
    for e in journal.entries().values():
        fs, at = file_system(spark, e.output)
        if e.run not in live and fs.exists(at):
            fs.delete(at, True)
            gone.append(e.output)
    journal.shorten()
    return sorted(gone)
