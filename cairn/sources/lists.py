"""Index list documents, index rows, queues and other plain lists as DataFrames.

Each source takes a policy for what it can't read: "fail" raises within the plan, "skip" leaves it out, "report" keeps it
with its reason in the column fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import cdx, digest, times

ITEM_COLUMNS = (*cdx.HEADER, "redirect", "robotflags", "offset", "filename")


def by_policy(df: DataFrame, policy: str, what: str) -> DataFrame:
    """df, which has a column fault, under a policy."""
    if policy == "report":
        return df
    if policy == "skip":
        return df.where("fault is null").drop("fault")
    if policy != "fail":
        raise ValueError(f"unknown policy {policy}")
    told = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit(f"{what}: "), "fault", F.lit(" in "), F.col("path"))).cast("boolean")).otherwise(F.lit(True))
    return df.where(told).drop("fault")


def _once(value: Column) -> Column:
    """A generator of one row with value, which is computed once a row, however often it is named later.

    The optimizer moves filters below a select, with its expressions in place of their names, but not below a generator.
    """
    return F.explode(F.array(value))


def _documents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, modified, rows) of whole files, plain or compressed as their names say; rows are null for what is no JSON."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    text = text.select(F.col("_metadata.file_path").alias("path"), F.unix_micros("_metadata.file_modification_time").alias("modified"), "value")
    return text.select("path", "modified", _once(F.from_json("value", "array<array<string>>")).alias("rows"))


def _layout(rows: Column) -> Column:
    head = F.get(rows, F.lit(0))
    return F.when(F.size(rows) == 0, 0).when(head == F.array(*map(F.lit, cdx.HEADER)), len(cdx.HEADER)).when(head == F.array(*map(F.lit, cdx.EXTENDED_HEADER)), len(cdx.EXTENDED_HEADER))


def _has_key(rows: Column) -> Column:
    """Whether the document ends with an empty row and a row of one resume key."""
    n = F.size(rows)
    return F.coalesce((n > 2) & (F.size(F.get(rows, n - 2)) == 0) & (F.size(F.get(rows, n - 1)) == 1), F.lit(False))


def index_lists(spark: SparkSession, path: str, policy: str = "fail", pattern: str = "*.json") -> DataFrame:
    """The rows of index list documents (JSON arrays of 7 or 11 texts after a header): path, modified, pos, the 11 columns.

    An empty array has no rows. Another header, no JSON, or a row of another length is a fault of the whole document.
    """
    docs = _documents(spark, path, pattern).withColumn("layout", _layout(F.col("rows"))).withColumn("key", _has_key(F.col("rows")))
    body = F.when(F.col("layout") > 0, F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1 - F.when(F.col("key"), 2).otherwise(0), F.lit(0)))).otherwise(F.array().cast("array<array<string>>"))
    docs = docs.withColumn("body", body)
    fault = F.when(F.col("rows").isNull(), "no_json").when(F.col("layout").isNull(), "header").when(F.exists("body", lambda r: F.coalesce(F.size(r) != F.col("layout"), F.lit(True))), "row_length")
    docs = docs.select("path", "modified", "layout", "body", _once(fault).alias("fault")).withColumn("body", F.when(F.col("fault").isNull(), F.col("body")))
    exploded = by_policy(docs, policy, "index list")
    generator = F.posexplode_outer if policy == "report" else F.posexplode
    rows = exploded.select("path", "modified", "layout", *(["fault"] if policy == "report" else []), generator("body").alias("pos", "r"))
    at = {7: cdx.HEADER, 11: cdx.EXTENDED_HEADER}
    columns = [F.when(F.col("layout") == 7, F.get("r", F.lit(at[7].index(n))) if n in at[7] else F.lit(None)).when(F.col("layout") == 11, F.get("r", F.lit(at[11].index(n)))).alias(n) for n in ITEM_COLUMNS]
    return rows.select("path", "modified", "pos", *columns, *(["fault"] if policy == "report" else []))


def resume_keys(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, resume_key) of the documents that have one."""
    docs = _documents(spark, path, pattern).where(_has_key(F.col("rows")))
    return docs.select("path", F.get(F.element_at("rows", -1), F.lit(0)).alias("resume_key"))


def typed_items(rows: DataFrame, policy: str = "fail") -> DataFrame:
    """Index rows with their types: ts timestamp, status and length numbers, digest with its bytes, dashes as nulls."""
    fault = F.when(~times.is_real(F.col("timestamp")), "timestamp").when(cdx.status_value(F.col("statuscode")).isNull(), "status_code").when(cdx.length_fault(F.col("length")), "length")
    typed = rows.drop("fault").select(
        "path", "pos", "urlkey", times.parse(F.col("timestamp")).alias("ts"), "original", F.col("mimetype").alias("mime_type"), cdx.status_value(F.col("statuscode")).alias("status_code"),
        "digest", digest.digest_bytes(F.col("digest")).alias("digest_bytes"), cdx.length_value(F.col("length")).alias("length"), cdx.dash_to_null(F.col("redirect")).alias("redirect"),
        cdx.dash_to_null(F.col("robotflags")).alias("robot_flags"), F.col("offset").try_cast("decimal(20,0)").alias("offset"), F.col("filename").alias("file_name"), fault.alias("fault"),
    )
    return by_policy(typed, policy, "index row")


def walk(spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = True, newest_first: bool = False) -> DataFrame:
    """(path, modified) of files, by path or the newest first; hidden files are left out."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select("path", F.col("modificationTime").alias("modified"))
    return files.orderBy(F.desc("modified"), "path") if newest_first else files.orderBy("path")


def classic_rows(texts: DataFrame, policy: str = "fail") -> DataFrame:
    """Space-separated index rows of text responses (path, value): path, pos, the 11 columns; 7, 9 or 11 fields a row.

    A blank line ends the rows of a response (what follows is its resume key). Absent fields are null.
    """
    lines = F.split("value", "\n")
    end = F.array_position(F.transform(lines, lambda x: F.trim(x)), F.lit(""))
    rows = texts.select("path", F.posexplode(F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)).alias("pos", "line"))
    parts = F.split("line", " ")
    layouts = {7: cdx.HEADER, 9: (*cdx.HEADER[:6], "redirect", "robotflags", "length"), 11: cdx.EXTENDED_HEADER}

    def column(name: str) -> Column:
        out = F.lit(None).cast("string")
        for n, names in layouts.items():
            if name in names:
                out = F.when(F.size(parts) == n, F.get(parts, F.lit(names.index(name)))).otherwise(out)
        return out.alias(name)

    told = rows.select("path", "pos", *[column(n) for n in ITEM_COLUMNS], F.when(~F.size(parts).isin(*layouts), "field_count").alias("fault"))
    return by_policy(told, policy, "index rows")


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Index requests from a headerless CSV: url, match_type, fast_latest, row_limit (null where absent)."""
    raw = spark.read.schema("url string, match_type string, fast_latest string, row_limit string").csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select("url", "match_type", (F.lower("fast_latest") == "true").alias("fast_latest"), F.col("row_limit").try_cast("bigint").alias("row_limit"))


def download_queue(spark: SparkSession, path: str, policy: str = "fail") -> DataFrame:
    """A download queue from a headerless CSV: url, ts, expected_digest."""
    raw = spark.read.schema("url string, timestamp string, expected_digest string").csv(path, escape='"').withColumn("path", F.lit(path))
    fault = F.when(~times.is_real(F.col("timestamp")), "timestamp").when(~digest.is_digest(F.col("expected_digest")), "digest")
    return by_policy(raw.select("path", "url", times.parse(F.col("timestamp")).alias("ts"), "expected_digest", fault.alias("fault")), policy, "queue").drop("path")


def digest_list(spark: SparkSession, path: str) -> DataFrame:
    """(digest, valid) of a text list; blanks around entries and blank lines don't count."""
    return spark.read.text(path).select(digest.strip(F.col("value")).alias("digest")).where("digest <> ''").select("digest", digest.is_digest(F.col("digest")).alias("valid"))


def screen_names(spark: SparkSession, path: str, policy: str = "fail") -> DataFrame:
    lines = spark.read.text(path).select(F.lit(path).alias("path"), F.col("value").alias("name"))
    return by_policy(lines.withColumn("fault", F.when(~F.col("name").rlike(r"\A[A-Za-z0-9_]+\z"), "screen_name")), policy, "screen names").drop("path")


def digest_urls(spark: SparkSession, path: str, prefix: str = "https://twitter.com", policy: str = "fail") -> DataFrame:
    raw = spark.read.schema("digest string, url string").csv(path).withColumn("path", F.lit(path))
    return by_policy(raw.withColumn("fault", F.when(F.col("url").isNotNull() & ~F.col("url").startswith(prefix), "url")), policy, "digest URLs").drop("path")
