"""Checking new batches for repeats, exact or near, against all records accepted so far, from a persistent store.

The store consists of runs, one for the first history and one for each step, merged when there are many of one size.
A run holds exact keys, texts and postings of winnowed fingerprints in buckets by hash, an order of rarity of its own
(so that phrases that became common later aren't taken for rare ones), and Bloom filters of its keys and fingerprints,
one per part of the hash space, sized for what they hold. A batch's fingerprints pass the filters of every run; only
the buckets that the positives name are read. Length and a map of the words sort out nearly all false candidates; what
is left is verified by the edit distance of the words. The accepted records then become a run of their own.

Records with one digest and one text are one class, whose first record stands for it.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import digest
from cairn.llm.fingerprints import Order, Texts, counted, near, post_text, words_of
from cairn.session import cut, file_system, shared_folder

#: Keys and fingerprints to a part of a filter, bits for each, and hashes.
PART_KEYS, KEY_BITS, HASHES = 1 << 13, 16, 4
#: Parts of a filter to a bucket (folder), and characters of text that a worker takes on at once.
PARTS_TOGETHER, MOST_CHARACTERS = 256, 4_000_000
#: Rows to a bucket, and buckets of a table at most (then they grow).
BUCKET_ROWS, MOST_BUCKETS = 1 << 15, 4096
#: Runs of similar size that are merged, and what counts as similar.
FANOUT = 8
#: Rows (some 60 to 100 bytes each) up to which what is looked up is broadcast.
MOST_BROADCAST = 200_000
#: Texts of a batch that show one key, beyond which the first of the batch are taken in a step of their own.
MOST_SHARING, FIRST_SHARE = 500, 8
POSTING = "print bigint, text_key string, words int, map_a bigint, map_b bigint, bucket int"
_TABLES = {"keys": "key string, id bigint, bucket int", "texts": "text_key string, norm string, bucket int", "postings": POSTING, "filters": "part int, bits binary, bucket int"}


def read_texts(df: DataFrame) -> DataFrame:
    """(id, dig, text_key, norm) of records (id, dig, content): the words of the post text, nulls where it has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [" ".join(words_of(text)) if (text := post_text(c)) else "" for c in batch.column(2).to_pylist()]
            keys = [xxhash.xxh3_128_hexdigest(n) if n else None for n in norms]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array([n or None for n in norms], pa.string())], names=["id", "dig", "text_key", "norm"])

    return df.select("id", "dig", "content").mapInArrow(run, "id bigint, dig string, text_key string, norm string")


def _pieces(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Batches cut so that a piece has about MOST_CHARACTERS at most in a column of texts, which comes with it."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= MOST_CHARACTERS or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), Texts.of([t.split(" ") for t in texts[start : i + 1]])
                start, size = i + 1, 0


def order_of(texts: DataFrame, total: int) -> Order:
    """The order of rarity of the fingerprints and words of texts (norm), of which there are total."""
    bits = Order.bits(32 * total)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _pieces(batches, 0):
            at, n = counted(data, bits)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])

    found = texts.select("norm").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row per counter
    at, n = found["at"].to_numpy(), found["n"].to_numpy()
    tables = []
    for mine, size in ((at >= 0, 1 << bits), (at < 0, 1 << 16)):
        table = np.zeros(size, dtype=np.int64)
        table[np.where(at[mine] >= 0, at[mine], -1 - at[mine])] = n[mine]
        tables.append(table)
    return Order.of(*tables)


def features(texts: DataFrame, own: Order, runs: dict[str, Order]) -> DataFrame:
    """(text_key, words, map_a, map_b, own, asked) of texts (text_key, norm).

    own are the keys that a text shows in its own order, asked, an array of (run, print), those in the orders of runs.
    """
    broadcast = texts.sparkSession.sparkContext.broadcast((own.to_bytes(), [o.to_bytes() for o in runs.values()]))
    names = list(runs)

    def listed(text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(text, kind="stable")
        return order, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, others = Order.from_bytes(broadcast.value[0]), [Order.from_bytes(b) for b in broadcast.value[1]]
        for batch, data in _pieces(batches, 1):
            n = batch.num_rows
            words, prints = data.words(), data.prints()
            text, shown = mine.chosen(data, words, prints)
            order, ends = listed(text, n)
            asked = [o.chosen(data, words, prints) for o in others]
            of = np.repeat(np.arange(len(asked), dtype=np.int32), [len(k) for _, k in asked]) if asked else np.zeros(0, np.int32)
            at, ask_ends = listed(np.concatenate([t for t, _ in asked]) if asked else np.zeros(0, np.int64), n)
            keys = (np.concatenate([k for _, k in asked]) if asked else np.zeros(0, np.int64))[at]
            pairs = pa.StructArray.from_arrays([pa.array(of[at], pa.int32()), pa.array(keys, pa.int64())], ["run", "print"])
            maps = [pa.array(m, pa.int64()) for m in data.maps()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data.sizes.astype(np.int32)), *maps, pa.ListArray.from_arrays(pa.array(ends), pa.array(shown[order], pa.int64())), pa.ListArray.from_arrays(pa.array(ask_ends), pairs)], names=["text_key", "words", "map_a", "map_b", "own", "asked"])

    out = texts.select("text_key", "norm").mapInArrow(run, "text_key string, words int, map_a bigint, map_b bigint, own array<bigint>, asked array<struct<run:int,print:bigint>>")
    named = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return out.withColumn("asked", F.transform("asked", lambda a: F.struct(F.get(named, a["run"]).alias("run"), a["print"].alias("print"))))


def _places(prints: np.ndarray, bits: int) -> np.ndarray:
    x = prints.astype(np.uint64)
    base, stride = x * np.uint64(0x9E3779B97F4A7C15), (x * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    return np.stack([((base + np.uint64(i) * stride) >> np.uint64(17)) % np.uint64(bits) for i in range(HASHES)]).astype(np.int64)


def _key_print(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 1)


def _hashed(value: Column, n: Column | int) -> Column:
    """A part or bucket, independent of the bits that the orders' counters use."""
    return F.pmod(F.xxhash64(value, F.lit(5)), n if isinstance(n, Column) else F.lit(n)).cast("int")


def keys_of(df: DataFrame, *columns: str) -> DataFrame:
    """The exact keys of records, digest and text, one row each with the named columns."""
    keys = F.array_compact(F.array(F.concat(F.lit("d:"), "dig"), F.concat(F.lit("t:"), "text_key")))
    return df.select(*columns, F.explode(keys).alias("key"))


def may_be_near() -> Column:
    """The tests of two texts, a and b, by length and word map, that every near pair passes."""
    longer = F.greatest("a.words", "b.words")
    most = F.floor(longer / 5)
    bits = F.bit_count(F.col("a.map_a").bitwiseXOR(F.col("b.map_a"))) + F.bit_count(F.col("a.map_b").bitwiseXOR(F.col("b.map_b")))
    return (F.abs(F.col("a.words") - F.col("b.words")) <= most) & (bits <= 2 * most)


def are_near(a: Column, b: Column) -> Column:
    """near() of two texts whose words stand between single blanks."""

    @F.pandas_udf("boolean")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x.split(" "), y.split(" ")) for x, y in zip(a, b)], dtype=bool)

    return of(a, b)


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


@dataclass(frozen=True)
class Run:
    """Part of a store: its size, the parts of its filter and the bits of each, the buckets of its tables."""

    name: str
    rows: int
    parts: int
    bits: int
    keys: int
    texts: int
    postings: int

    @property
    def filters(self) -> int:
        return -(-self.parts // PARTS_TOGETHER) if self.rows else 0


class History:
    """A store of accepted records in a folder that all executors share; one writer at a time.

    A step counts once its mark is there, which is put in place last and by a rename and names the runs that make up the
    store; what a broken step has written is never read, and clean_up removes it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.runs: list[Run] = []
        self.steps = 0
        self._orders: dict[str, Order] = {}
        fs, at = file_system(spark, f"{folder}/marks")
        marks = sorted((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), reverse=True) if fs.exists(at) else []
        if marks:
            self.steps = marks[0] + 1
            self.runs = [Run(**r) for r in json.loads(self._get(f"marks/{marks[0]}"))]

    def _get(self, name: str) -> bytes:
        return bytes(self.spark.read.format("binaryFile").load(f"{self.folder}/{name}").first().content)

    def _put(self, name: str, content: bytes) -> None:
        fs, final = file_system(self.spark, f"{self.folder}/{name}")
        folder, _, last = name.rpartition("/")
        _, waiting = file_system(self.spark, f"{self.folder}/{folder}/.{last}.tmp")
        out = fs.create(waiting, True)
        out.write(bytearray(content))
        out.close()
        if not fs.rename(waiting, final):
            raise OSError(f"{name} can't be put in place")

    def _commit(self, runs: list[Run]) -> None:
        self._put(f"marks/{self.steps}", json.dumps([asdict(r) for r in runs]).encode())
        self.steps, self.runs = self.steps + 1, runs

    def order(self, run: Run) -> Order:
        if run.name not in self._orders:
            self._orders[run.name] = Order.from_bytes(self._get(f"runs/{run.name}/order"))
        return self._orders[run.name]

    def clean_up(self) -> None:
        """Removes runs that aren't part of the store (merged, or of broken steps) and all marks but the last."""
        fs, at = file_system(self.spark, f"{self.folder}/runs")
        live = {r.name for r in self.runs}
        for s in fs.listStatus(at) if fs.exists(at) else []:
            if s.getPath().getName() not in live:
                fs.delete(s.getPath(), True)
        _, at = file_system(self.spark, f"{self.folder}/marks")
        for s in fs.listStatus(at):
            if s.getPath().getName() != str(self.steps - 1):
                fs.delete(s.getPath(), False)

    def read(self, table: str, runs: list[Run] | None = None, buckets: dict[str, list[int]] | None = None) -> DataFrame:
        """A table of runs with the run's name, or only the given buckets of each run, of which others' files aren't opened."""
        out = []
        for r in self.runs if runs is None else runs:
            if getattr(r, table) and (buckets is None or buckets.get(r.name)):
                df = self.spark.read.schema(_TABLES[table]).parquet(f"{self.folder}/runs/{r.name}/{table}")
                if buckets is not None and len(buckets[r.name]) < getattr(r, table):
                    df = df.where(F.col("bucket").isin(buckets[r.name]))
                out.append(df.drop("bucket").withColumn("run", F.lit(r.name)))
        if not out:
            return self.spark.createDataFrame([], _TABLES[table].replace("bucket int", "run string"))
        return reduce(DataFrame.unionByName, out)

    def _of_run(self, field: str) -> Column:
        """A number of the run that the column run names."""
        return F.element_at(F.create_map(*[x for r in self.runs for x in (F.lit(r.name), F.lit(getattr(r, field)))]), F.col("run"))

    def _buckets(self, named: DataFrame, table: str, key: str) -> dict[str, list[int]]:
        """The buckets of each run in which the keys of named (run, key) are; at most as many as the store has."""
        out: dict[str, list[int]] = defaultdict(list)
        if self.runs:
            for r in named.select("run", _hashed(F.col(key), self._of_run(table)).alias("bucket")).distinct().collect():
                out[r.run].append(r.bucket)
        return out

    def _write(self, keys: DataFrame, texts: DataFrame, feats: DataFrame, order: Order) -> Run:
        """A run of keys (key, id), of which the least id counts, texts (text_key, norm) and their features by order."""
        keys = cut(keys.groupBy("key").agg(F.min("id").alias("id")), "history")
        name = f"{self.steps}-{uuid.uuid4().hex[:12]}"
        at = f"{self.folder}/runs/{name}"
        sizes = feats.agg(F.count("*").alias("texts"), F.sum(F.size("own")).alias("postings")).first()
        held = {"keys": keys.count(), "texts": sizes.texts, "postings": sizes.postings or 0}
        buckets = {t: min(MOST_BUCKETS, -(-n // BUCKET_ROWS)) for t, n in held.items()}
        postings = feats.select(F.explode("own").alias("print"), "text_key", "words", "map_a", "map_b")
        for table, df, key in (("keys", keys, "key"), ("texts", texts, "text_key"), ("postings", postings, "print")):
            if buckets[table]:
                placed = df.withColumn("bucket", _hashed(F.col(key), buckets[table])).repartition(buckets[table], "bucket")
                (placed.sortWithinPartitions("bucket", key) if table == "postings" else placed.sortWithinPartitions("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/{table}")
        self._put(f"runs/{name}/order", order.to_bytes())
        self._orders[name] = order
        n = held["keys"] + held["postings"]
        parts = max(1, -(-n // PART_KEYS))
        bits = 1 << max(10, math.ceil(math.log2(KEY_BITS * max(1, n) / parts)))
        run = Run(name, n, parts, bits, **buckets)
        if n:
            self._filters(run).withColumn("bucket", F.floor(F.col("part") / PARTS_TOGETHER).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/filters")
        return run

    def _filters(self, run: Run) -> DataFrame:
        """(part, bits) of a run's keys and fingerprints, read as a stream by part: a task holds one part's filter."""

        def built(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, table = None, np.zeros(run.bits // 8, dtype=np.uint8)
            for batch in batches:
                parts, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        if parts[a] != part:
                            if part is not None:
                                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["part", "bits"])
                            part, table = int(parts[a]), np.zeros(run.bits // 8, dtype=np.uint8)
                        places = _places(prints[a:b], run.bits).ravel()
                        np.bitwise_or.at(table, places >> 3, (1 << (places & 7)).astype(np.uint8))
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["part", "bits"])

        prints = self.read("postings", [run]).select("print").unionByName(self.read("keys", [run]).select(_key_print(F.col("key")).alias("print")))
        return prints.select(_hashed(F.col("print"), run.parts).alias("part"), "print").repartition(run.parts, "part").sortWithinPartitions("part").mapInArrow(built, "part int, bits binary")

    def positives(self, prints: DataFrame) -> DataFrame:
        """The distinct (run, print) of prints that the run's filters don't rule out. A part's filter goes first, its prints after it."""
        runs = [r for r in self.runs if r.rows]
        nothing = self.spark.createDataFrame([], "run string, print bigint")
        if not runs:
            return nothing

        def passed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, table = None, np.zeros(1, dtype=np.uint8)
            for batch in batches:
                run, part = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
                prints, bits = batch.column(2), batch.column(3)
                cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (run[1:] != run[:-1])) + 1), len(part)] if len(part) else [0]
                for a, b in zip(cuts, cuts[1:]):
                    if (run[a], part[a]) != at:
                        at, table = (run[a], part[a]), np.zeros(0, dtype=np.uint8)
                    if bits[a].is_valid:
                        table, a = np.frombuffer(bits[a].as_py(), dtype=np.uint8), a + 1
                    if a == b or not len(table):
                        continue
                    asked = prints.slice(a, b - a).to_numpy()
                    places = _places(asked, len(table) * 8)
                    good = asked[((table[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)]
                    yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(good), pa.string()), pa.array(good, pa.int64())], names=["run", "print"])

        asked = prints.select("run", "print").distinct().select("run", _hashed(F.col("print"), self._of_run("parts")).alias("part"), "print", F.lit(None).cast("binary").alias("bits"))
        buckets = None
        if sum(r.filters for r in runs) > 4 * len(runs):
            buckets = defaultdict(list)
            for r in asked.select("run", F.floor(F.col("part") / PARTS_TOGETHER).cast("int").alias("bucket")).distinct().collect():  # as many as the store has at most
                buckets[r.run].append(r.bucket)
        filters = self.read("filters", runs, buckets).select("run", "part", F.lit(None).cast("bigint").alias("print"), "bits")
        both = asked.unionByName(filters)
        return both.repartition("run", "part").sortWithinPartitions("run", "part", F.col("bits").isNull()).mapInArrow(passed, "run string, print bigint")

    def start(self, records: DataFrame) -> None:
        """Takes a history of accepted records (id, dig, content), all of them, into an empty store."""
        rows = cut(read_texts(records), "history")
        texts = cut(rows.where("text_key is not null").groupBy("text_key").agg(F.first("norm").alias("norm")), "history")
        self._commit([*self.runs, self._run_of(keys_of(rows, "id"), texts)])

    def _run_of(self, keys: DataFrame, texts: DataFrame) -> Run:
        """A run of all keys (key, id), of which the least id counts, and texts (text_key, norm)."""
        order = order_of(texts, texts.count())
        return self._write(keys, texts, cut(features(texts, order, {}), "history"), order)

    def _merge(self) -> None:
        """Merges runs while there are FANOUT or more of similar size; merged texts get an order and fingerprints anew."""
        while True:
            tiers: dict[int, list[Run]] = defaultdict(list)
            for r in self.runs:
                tiers[int(math.log(max(1, r.rows), FANOUT))].append(r)
            crowded = [t for t in sorted(tiers) if len(tiers[t]) >= FANOUT]
            if not crowded:
                return
            old = tiers[crowded[0]]
            texts = cut(self.read("texts", old).groupBy("text_key").agg(F.first("norm").alias("norm")), "history")
            merged = self._run_of(self.read("keys", old).select("key", "id"), texts)
            self._commit([r for r in self.runs if r not in old] + [merged])

    def check(self, batch: DataFrame, may_split: bool = True) -> DataFrame:
        """(accepted_id, id) of each record of a batch (id, dig, content) that repeats an accepted one with a smaller id.

        Records that repeat none are accepted into the store, in the order of their ids, so that later records of the
        batch are held against them too. accepted_id is the smallest id that fits. dig and content may be null: a record
        without both repeats nothing. Repeated ids count as one record per class. An empty batch has no repeats. Ids need
        not be above those accepted before: a record is held against smaller ids only, and earlier decisions stand.
        """
        return self._check(cut(read_texts(batch), "history"), may_split)

    def _check(self, rows: DataFrame, may_split: bool) -> DataFrame:
        reps = cut(rows.where("dig is not null or text_key is not null").groupBy("dig", "text_key").agg(F.min("id").alias("id")), "history")
        texts = cut(rows.where("text_key is not null").groupBy("text_key").agg(F.first("norm").alias("norm")), "history")
        own = order_of(texts, texts.count())
        feats = cut(features(texts, own, {r.name: self.order(r) for r in self.runs if r.postings}), "history")

        names = [F.lit(r.name) for r in self.runs]
        asked = feats.select("text_key", "words", "map_a", "map_b", F.inline("asked"))
        keys = keys_of(reps, "id").withColumns({"print": _key_print(F.col("key")), "run": F.explode(F.array(*names) if names else F.array().cast("array<string>"))})
        positive = cut(self.positives(asked.select("run", "print").unionByName(keys.select("run", "print"))), "history")
        hit = _if_small(cut(asked.join(positive, ["run", "print"], "left_semi"), "history"))
        stored = self.read("postings", buckets=self._buckets(hit, "postings", "print"))
        meet = hit.alias("a").join(stored.alias("b"), (F.col("a.run") == F.col("b.run")) & (F.col("a.print") == F.col("b.print")))
        pairs = cut(meet.where(may_be_near() & (F.col("a.text_key") != F.col("b.text_key"))).select(F.col("a.text_key").alias("text_key"), F.col("b.run").alias("run"), F.col("b.text_key").alias("other")).distinct(), "history")
        norms = self.read("texts", buckets=self._buckets(pairs.withColumn("text_key", F.col("other")), "texts", "text_key")).select("run", F.col("text_key").alias("other"), F.col("norm").alias("other_norm"))
        compared = norms.join(_if_small(pairs), ["run", "other"]).join(texts, "text_key")
        found = compared.where(are_near(F.col("norm"), F.col("other_norm"))).select("text_key", "run", F.concat(F.lit("t:"), "other").alias("key"))

        exact = keys.join(positive, ["run", "print"], "left_semi").select("id", "run", "key")
        wanted = cut(exact.unionByName(found.join(reps, "text_key").select("id", "run", "key")), "history")
        accepted = self.read("keys", buckets=self._buckets(wanted, "keys", "key")).withColumnRenamed("id", "accepted_id")
        matched = _if_small(wanted).join(accepted, ["run", "key"]).where("accepted_id < id").groupBy("id").agg(F.min("accepted_id").alias("accepted_id"))
        state = cut(reps.join(matched, "id", "left"), "history")

        least = state.where("accepted_id is null").agg(F.min("id")).first()[0]
        of_new = F.col("accepted_id").isNull() | (F.col("accepted_id") > F.lit(least))  # only ids below the store's can make known repeats' accepted_id smaller
        left = state.where(of_new).select("id", "dig", "text_key", F.when(F.col("accepted_id").isNotNull(), 2).otherwise(0).alias("state"))
        shown = feats.join(left.select("text_key").distinct(), "text_key", "left_semi").select(F.explode("own").alias("print"), "text_key", "words", "map_a", "map_b")
        if may_split and (at := self._first_share(shown, left)) is not None:
            first = self._check(cut(rows.where(F.col("id") <= at), "history"), True)
            return first.unionByName(self._check(rows.where(F.col("id") > at), False))
        meet = shown.alias("a").join(shown.alias("b"), F.col("a.print") == F.col("b.print")).where((F.col("a.text_key") < F.col("b.text_key")) & may_be_near())
        inner = meet.select(F.col("a.text_key").alias("text_key"), F.col("b.text_key").alias("other")).distinct()
        compared = inner.join(texts, "text_key").join(texts.select(F.col("text_key").alias("other"), F.col("norm").alias("other_norm")), "other")
        edges = cut(compared.where(are_near(F.col("norm"), F.col("other_norm"))).select("text_key", "other"), "history")
        decided = self._decide(left, edges.unionByName(edges.select(F.col("other").alias("text_key"), F.col("text_key").alias("other"))))
        accepted_id = F.least(state["accepted_id"], F.when(decided["accepted_id"] < state["id"], decided["accepted_id"]))
        judged = cut(state.join(decided, "id", "left").select("id", "dig", "text_key", accepted_id.alias("accepted_id")), "history")
        told = rows.select("id", "dig", "text_key").alias("r").join(judged.alias("j"), F.col("r.dig").eqNullSafe(F.col("j.dig")) & F.col("r.text_key").eqNullSafe(F.col("j.text_key"))).select(F.coalesce("j.accepted_id", "j.id").alias("accepted_id"), F.col("r.id").alias("id"))
        cases = cut(told.where("accepted_id < id"), "history")
        new = judged.where("accepted_id is null").select("id", "dig", "text_key")
        fresh = cut(feats.join(new.select("text_key").distinct(), "text_key", "left_semi"), "history")
        self._commit([*self.runs, self._write(keys_of(new, "id"), texts.join(fresh.select("text_key"), "text_key", "left_semi"), fresh, own)])
        self._merge()
        return cases

    @staticmethod
    def _first_share(shown: DataFrame, left: DataFrame) -> int | None:
        """The id that ends the first share of a batch, if very many of its texts share a key; None if they don't."""
        if (shown.groupBy("print").count().agg(F.max("count")).first()[0] or 0) <= MOST_SHARING:
            return None
        ends = left.agg(F.percentile_approx("id", 1 / FIRST_SHARE), F.max("id")).first()
        return ends[0] if ends[0] < ends[1] else None

    @staticmethod
    def _decide(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """(id, accepted_id or null) of records: those that match nothing old (state 0) are held against smaller accepted ids.

        Records that repeat an old one (state 2) are never accepted, but may repeat one with a smaller id as well.

        Rounds: who has no living smaller neighbour is accepted, who has an accepted smaller one is a case and dead. Each
        round decides at least the smallest undecided record of every chain, and all neighbours of the accepted.
        """
        nodes = cut(nodes, "history")
        while True:
            alive, taken = F.when(F.col("state") < 2, F.col("id")), F.when(F.col("state") == 1, F.col("id"))
            if not nodes.where("state = 0").head(1):
                break
            ranked = History._neighbours(nodes, edges, alive, taken)
            next_state = F.when(F.col("state") > 0, F.col("state")).when(F.col("taken") < F.col("id"), 2).when(~F.coalesce(F.col("alive") < F.col("id"), F.lit(False)), 1).otherwise(0)
            nodes = cut(ranked.select("id", "dig", "text_key", next_state.alias("state")), "history")
        final = History._neighbours(nodes, edges, alive, taken)
        return final.select("id", F.when(F.col("state") == 2, F.col("taken")).alias("accepted_id"))

    @staticmethod
    def _neighbours(nodes: DataFrame, edges: DataFrame, alive: Column, taken: Column) -> DataFrame:
        """nodes with the least living and the least accepted id among those of one digest, of one text, or of near texts."""
        marked = nodes.select("id", "dig", "text_key", "state", alive.alias("my_alive"), taken.alias("my_taken"))

        def least(df: DataFrame, key: str, name: str) -> DataFrame:
            return df.where(f"{key} is not null").groupBy(key).agg(F.min("my_alive").alias(f"alive_{name}"), F.min("my_taken").alias(f"taken_{name}"))

        by_text = least(marked, "text_key", "t")
        by_near = edges.join(by_text.withColumnRenamed("text_key", "other"), "other").groupBy("text_key").agg(F.min("alive_t").alias("alive_n"), F.min("taken_t").alias("taken_n"))
        out = marked.join(least(marked, "dig", "d"), "dig", "left").join(by_text, "text_key", "left").join(by_near, "text_key", "left")
        return out.select("id", "dig", "text_key", "state", F.least("alive_d", "alive_t", "alive_n").alias("alive"), F.least("taken_d", "taken_t", "taken_n").alias("taken"))


def repeats(snapshots: DataFrame, results: DataFrame, batches_at_once: int = 5) -> DataFrame:
    """(accepted_id, result_id) of each successful result that repeats an accepted record; see History.check.

    Batches are taken in their order, some at a time, each step against the store only. A null batch comes last.
    """
    spark = results.sparkSession
    store = History(spark, shared_folder(spark, "history"))
    store.start(snapshots.select(snapshots["snap_id"].alias("id"), digest.clean_digest(snapshots["digest"]).alias("dig"), snapshots["content"].alias("content")))
    batch = F.coalesce(results["batch_no"], F.lit((1 << 31) - 1))
    found = results.where(results["outcome"] == "success").select(batch.alias("batch"), results["result_id"].alias("id"), digest.clean_digest(F.coalesce(results["actual_digest"], results["expected_digest"])).alias("dig"), results["content"].alias("content"))
    numbers = sorted(r.batch for r in found.select("batch").distinct().collect())  # a row per batch
    cases = [store.check(found.where(F.col("batch").isin(numbers[i : i + batches_at_once])).select("id", "dig", "content")) for i in range(0, len(numbers), batches_at_once)]
    return reduce(DataFrame.unionByName, cases, spark.createDataFrame([], "accepted_id bigint, id bigint")).withColumnRenamed("id", "result_id")
