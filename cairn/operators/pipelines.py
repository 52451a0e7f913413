"""Whole jobs on digest-named files, snapshot lines and index rows, put together from the other operators."""

from __future__ import annotations

import gzip
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import digest, gzipformat, jsontext, snapshot
from cairn.operators import archive
from cairn.sources import files, lists

DATA_RULES = (('{"created_at":', "flat"), ('{"data":', "data"))


def _line(name: Column, expected: Column, stamp: Column, url: Column, form: Column, content: Column) -> Column:
    return snapshot.render(name, expected, stamp, url, form, content).alias("line")


def body_fields(data: Column, name: Column, default: str = "\n") -> dict[str, Column]:
    """From a file's bytes: content, form (JSON or null) and fault (digest_mismatch, not_utf8, not_a_single_line or null).

    A gzip body whose parameters can be found has its text as content and the parameters in form; any other must be UTF-8,
    its closing white space goes into form where it isn't the default.
    """
    found = F.when(F.substring(data, 1, 2) == F.lit(b"\x1f\x8b"), gzipformat.detected(data))
    text = F.when(found.isNotNull(), gzipformat.decompressed(data)).otherwise(F.try_validate_utf8(data.cast("string")))
    content = F.when(found.isNotNull(), text).otherwise(F.regexp_replace(text, snapshot.WHITESPACE, ""))
    space = snapshot.closing_whitespace(text, default)
    form = F.coalesce(found, F.when(space.isNotNull(), F.to_json(F.struct(space.alias("closing_whitespace")))))
    fault = F.when(digest.sha1_base32(data) != name, "digest_mismatch").when(text.isNull(), "not_utf8").when(content.rlike(r"[\r\n]"), "not_a_single_line")
    return {"content": content, "form": form, "fault": fault}


def pack(named: DataFrame, log: DataFrame, default: str = "\n") -> DataFrame:
    """(digest, line, reason) of digest-named files (path, digest, content): a snapshot line, or the reason for none.

    Of files with one name the first path counts. expected_digest comes from the log (actual_digest, expected_digest,
    observed), the last observed one. Files whose name is no digest have the reason name_is_no_digest.
    """
    strays = named.where("digest is null").select(F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("line"), F.lit("name_is_no_digest").alias("reason"))
    one = named.where("digest is not null").groupBy("digest").agg(F.min_by("content", "path").alias("data"))
    f = body_fields(F.col("data"), F.col("digest"), default)
    last = log.groupBy(F.col("actual_digest").alias("digest")).agg(F.max_by("expected_digest", "observed").alias("expected_digest"))
    rows = one.select("digest", *[v.alias(k) for k, v in f.items()]).join(last, "digest", "left")
    none = F.lit(None).cast("string")
    line = F.when(F.col("fault").isNull(), _line(F.col("digest"), F.col("expected_digest"), none, none, F.col("form"), F.col("content")))
    return rows.select("digest", line.alias("line"), F.col("fault").alias("reason")).unionByName(strays)


def partition_of(text: Column, rules: tuple[tuple[str, str], ...] = DATA_RULES) -> Column:
    """The partition whose prefix a content has, else null."""
    out = F.lit(None).cast("string")
    for prefix, place in reversed(rules):
        out = F.when(text.startswith(prefix), place).otherwise(out)
    return out


def compact_files(named: DataFrame, captures: DataFrame, log: DataFrame, rules: tuple[tuple[str, str], ...] = DATA_RULES, default: str = "\n", skip_unresolved: bool = False) -> DataFrame:
    """(digest, place, line, reason) of digest-named files, enriched with their earliest captures, by partition.

    reason is a body's fault, no_partition, or unresolved (where those are skipped); else null and line holds the snapshot.
    """
    one = named.where("digest is not null").groupBy("digest").agg(F.min_by("content", "path").alias("data"))
    found = archive.resolve(one.select("digest"), captures, log).select("digest", "ts", "url", "expected_digest")
    f = body_fields(F.col("data"), F.col("digest"), default)
    rows = one.select("digest", *[v.alias(k) for k, v in f.items()]).join(found, "digest", "left").withColumn("place", partition_of(F.col("content"), rules))
    unresolved = F.lit(skip_unresolved) & F.col("ts").isNull()
    reason = F.coalesce("fault", F.when(F.col("place").isNull(), "no_partition"), F.when(unresolved, "unresolved"))
    line = F.when(reason.isNull(), _line(F.col("digest"), F.col("expected_digest"), F.col("ts"), F.col("url"), F.col("form"), F.col("content")))
    return rows.select("digest", "place", line.alias("line"), reason.alias("reason"))


def legacy_verify(named: DataFrame) -> DataFrame:
    """(path, digest, found, ok) of legacy files (path, digest, compression, content), hashed after decompression; null found for broken ones."""

    @F.pandas_udf("binary")
    def plain(kind: pd.Series, data: pd.Series) -> pd.Series:
        def one(k, b):
            try:
                if k == "gz":
                    return gzip.decompress(b)
                if k == "zst":
                    import zstandard

                    return zstandard.ZstdDecompressor().decompressobj().decompress(b)
                return b
            except Exception:  # whatever is wrong with a file, it is broken
                return None

        return pd.Series([one(k, b) for k, b in zip(kind, data)], dtype=object)

    rows = named.where("digest is not null").select("path", "digest", digest.sha1_base32(plain(F.col("compression"), F.col("content"))).alias("found"))
    return rows.withColumn("ok", F.coalesce(F.col("found") == F.col("digest"), F.lit(False)))


def verify_all(checked: DataFrame) -> DataFrame:
    """One row: whether all files are what their names say, how many were checked, how many aren't."""
    return checked.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("mismatches"))


def extract_rows(spark: SparkSession, containers: list[str], policy: str = "fail") -> DataFrame:
    """(url, ts, digest, mime_type, status) of the index rows in a client's archived answers; dashes where a field is absent."""
    answers = files.warc_responses(spark, containers).select("path", F.try_validate_utf8(F.col("body").cast("string")).alias("value"))
    rows = lists.classic_rows(answers, policy)
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return rows.select(F.col("original").alias("url"), F.col("timestamp").alias("ts"), dash(F.col("digest")).alias("digest"), dash(F.col("mimetype")).alias("mime_type"), dash(F.col("statuscode")).alias("status"))


def clean_report(named: DataFrame, known: DataFrame) -> DataFrame:
    """One row (total, valid, known) of files (name) against known digests; a dry run, nothing is deleted."""
    rows = named.select("name", digest.is_digest(F.col("name")).alias("valid")).join(known.select(F.col("digest").alias("name")).distinct().withColumn("there", F.lit(True)), "name", "left")
    return rows.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.col("there").isNotNull()).alias("known"))


def urls_to_fill(snapshots: DataFrame, include_timestamped: bool = False) -> DataFrame:
    """(digest, url): the inferred URL, or null, of snapshots (digest, expected_digest, ts, url, content) without one."""
    bare = F.col("url").isNull() & (F.lit(include_timestamped) | (F.col("ts").isNull() & F.col("expected_digest").isNull()))
    return snapshots.where(bare).select("digest", snapshot.inferred_url(F.col("content")).alias("url"))


def migrated(line: Column) -> Column:
    """An old snapshot line (format a text, closing_whitespace beside it) as a new one; other fields keep their exact text.

    New lines come out as they are but for the order of fields. What is no JSON object gives null.
    """

    def one(text: str | None) -> str | None:
        try:
            members = {n: (v, raw) for n, v, raw in jsontext.members(text or "")}
        except ValueError:
            return None
        old = members.get("format", (None, ""))[0]
        form: dict = {} if not isinstance(old, dict) else json.loads(members["format"][1])
        if isinstance(old, str) and old != "utf8":
            form = {"type": str(old)}
        if "closing_whitespace" in members:
            form["closing_whitespace"] = json.loads(members["closing_whitespace"][1])
        parts = [(n, members[n][1]) for n in ("digest", "expected_digest", "timestamp", "url") if n in members]
        parts += [("format", json.dumps(form, ensure_ascii=False, separators=(",", ":")))] if form else []
        parts += [("content", members["content"][1])] if "content" in members else []
        return "{" + ",".join(f'"{n}":{raw}' for n, raw in parts) + "}"

    @F.pandas_udf("string")
    def of(lines: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in lines], dtype=object)

    return of(line)


def plain_report(lines: DataFrame, file: str, number: str, default: str = "\n") -> DataFrame:
    """A stand-alone check of a file's lines: valid, invalid, misplaced, skipped (lines of another format type) and in all."""
    t = archive.snapshot_state(lines, default).withColumn("digest", F.col("parsed.digest"))
    state = F.when(F.col("state") == "unsupported_format", "skipped").when(F.col("state") == "ok", "valid").otherwise("invalid")
    ordered = archive.order_report(t.withColumn("verdict", state), file, number, "digest")
    return ordered.groupBy(file).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("valid", "invalid", "skipped")], F.count_if(F.col("status").isin("duplicate", "out_of_order")).alias("misplaced"), F.count("*").alias("lines"))


def snapshot_lines(texts: DataFrame, default: str = "\n") -> DataFrame:
    """(digest, line, fault) of raw texts (text): the snapshot each makes, its digest computed from all of it."""
    u = snapshot.unprocessed(F.col("text"))
    rows = texts.select(digest.sha1_base32(F.col("text")).alias("digest"), u.alias("u"))
    form = F.when(F.col("u.space") != default, F.to_json(F.struct(F.col("u.space").alias("closing_whitespace"))))
    none = F.lit(None).cast("string")
    line = F.when(F.col("u.fault").isNull(), _line(F.col("digest"), none, none, none, form, F.col("u.content")))
    return rows.select("digest", line.alias("line"), F.col("u.fault").alias("fault"))
