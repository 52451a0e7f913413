"""The log of wrongly declared digests: import from SQLite files and CSV bundles, export to CSV."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import digest, times

KEY = ["url", "archive_ts", "expected_digest", "actual_digest"]


def sqlite_log(spark: SparkSession, path: str, since: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(invalid digests, withheld URLs) of a SQLite log, a small file by nature, from an observation on."""
    base32 = lambda b: digest_text(bytes(b))
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        where, args = ("", ()) if since is None else (" where timestamp >= ?", (since,))
        bad = [(o, u, a, e, base32(d)) for o, u, a, e, d in db.execute(f"select timestamp, url, archive_timestamp, expected_digest, actual_digest from invalid_digest{where} order by timestamp, id", args)]
        withheld = list(db.execute(f"select timestamp, url from withheld_url{where} order by timestamp, id", args))
    rows = spark.createDataFrame(bad, "observed bigint, url string, archive_seconds bigint, expected_digest string, actual_digest string")
    stamped = rows.select("observed", "url", times.text_of(times.from_unix(F.col("archive_seconds"))).alias("archive_ts"), "expected_digest", "actual_digest")
    return stamped, spark.createDataFrame(withheld, "observed bigint, url string")


def digest_text(data: bytes) -> str:
    import base64

    return base64.b32encode(data).decode()


def csv_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    bad = spark.read.schema("observed bigint, url string, archive_timestamp string, expected_digest string, actual_digest string").csv(f"{folder}/invalid-digests.csv", header=True, escape='"')
    withheld = spark.read.schema("observed bigint, url string").csv(f"{folder}/withheld-urls.csv", header=True, escape='"')
    return bad.where(digest.is_digest(F.col("actual_digest"))).withColumnRenamed("archive_timestamp", "archive_ts"), withheld


#: CSV that keeps blanks and quotes as they are.
_EXACT = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "errorifexists"}


def write_csv_log(bad: DataFrame, withheld: DataFrame, folder: str) -> None:
    """Two CSV data sets with headers, ordered by observation."""
    columns = ["observed", "url", F.col("archive_ts").alias("archive_timestamp"), "expected_digest", "actual_digest"]
    bad.select(*columns).orderBy("observed", "url").write.csv(f"{folder}/invalid-digests.csv", header=True, **_EXACT)
    withheld.select("observed", "url").orderBy("observed", "url").write.csv(f"{folder}/withheld-urls.csv", header=True, **_EXACT)


def write_headerless(df: DataFrame, path: str, columns: list[str]) -> None:
    """Download queues, digest lists, item lists: headerless CSV of the named columns."""
    df.select(*columns).write.csv(path, **_EXACT)
