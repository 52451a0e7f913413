"""Digest-named files and stores, numbered lines of (compressed) text files, and web-archive containers."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions import digest

STEM = r"^(?i)([A-Z2-7]{32})(?:\.(zst|gz))?$"


def digest_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, digest or null for strays, content) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.when(digest.is_digest(name), name).alias("digest"), "content")


def legacy_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, compression, content) of a legacy tree: a digest in any case, plain, .zst or .gz; else nulls (skipped)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stem, kind = F.upper(F.nullif(F.regexp_extract(name, STEM, 1), F.lit(""))), F.regexp_extract(name, STEM, 2)
    return files.select("path", stem.alias("digest"), F.when(stem.isNotNull(), F.when(kind == "", "none").otherwise(F.lower(kind))).alias("compression"), "content")


def store_entries(spark: SparkSession, path: str) -> DataFrame:
    """A store's entries in digest order (by bytes); *.tmp are left out, other bad names raise."""
    files = digest_files(spark, path).where(~F.col("name").endswith(".tmp"))
    good = F.when(F.col("digest").isNull(), F.raise_error(F.concat(F.lit("no digest: "), "path")).cast("boolean")).otherwise(F.lit(True))
    return files.where(good).orderBy(digest.order_key(F.col("digest")))


def prefix_lengths(spark: SparkSession, path: str) -> list[int]:
    """The lengths of a store's prefix folders, from the path of one entry; ValueError for an empty store."""
    first = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("path not like '%.tmp'").select("path").first()
    if first is None:
        raise ValueError("empty store")
    root = path.removeprefix("file:").rstrip("/").lstrip("/")
    inner = first.path.removeprefix("file:").lstrip("/").removeprefix(root).strip("/")
    return [len(p) for p in inner.split("/")[:-1]]


def _open(path: str) -> io.BufferedIOBase:
    local = path.removeprefix("file://").removeprefix("file:")
    if path.endswith(".zst"):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(open(local, "rb"), read_across_frames=True))
    return gzip.open(local, "rb") if path.endswith(".gz") else open(local, "rb")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _PerFile(DataSourceReader):
    """One partition per path of the option paths (separated by LF); the files stand where all executors see them."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", "").split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths] or [_File("")]


class _LineReader(_PerFile):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            with _open(partition.value) as f:
                for n, line in enumerate(f, 1):
                    line = line.removesuffix(b"\n").removesuffix(b"\r")
                    try:
                        yield partition.value, n, line.decode(), None
                    except UnicodeDecodeError:
                        yield partition.value, n, None, "not UTF-8"


class NumberedLines(DataSource):
    """path, line_no, line, fault of text files, plain, .gz or .zst; a CR before the LF is dropped. Order within files kept."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "path string, line_no bigint, line string, fault string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


def warc_records(f: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (in lower case) and block of each record of an uncompressed container."""
    while True:
        line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("no record where one should begin")
            continue
        fields = {}
        while (line := f.readline().strip()) :
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
        yield fields, f.read(int(fields.get("content-length", 0)))


class _WarcReader(_PerFile):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        with open(partition.value.removeprefix("file://").removeprefix("file:"), "rb") as raw:
            packed = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            for fields, block in warc_records(io.BufferedReader(gzip.GzipFile(fileobj=raw))) if packed else warc_records(raw):
                if fields.get("warc-type") == "response":
                    head, _, body = block.partition(b"\r\n\r\n")
                    status = head.split(b"\r\n", 1)[0].split(b" ")
                    code = int(status[1]) if len(status) > 1 and status[1].isdigit() else None
                    yield partition.value, fields.get("warc-target-uri"), fields.get("warc-date"), code, body


class WarcResponses(DataSource):
    """path, url, date, status, body of the response records of containers, plain or gzip by their first bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc_responses"

    def schema(self) -> str:
        return "path string, url string, date string, status int, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _WarcReader(self.options)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(NumberedLines)
    return spark.read.format("numbered_lines").option("paths", "\n".join(paths)).load()


def warc_responses(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The responses with status 200."""
    spark.dataSource.register(WarcResponses)
    return spark.read.format("warc_responses").option("paths", "\n".join(paths)).load().where("status = 200")
