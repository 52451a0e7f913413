"""Queries for sources and sinks: whole tables are written in a source's format to the shared folder and read back by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import cdx, digest, gzipformat
from cairn.plans import sqltext as q
from cairn.plans.archive_queries import c, log, query
from cairn.session import shared_folder, table
from cairn.sources import files, lists, logs, sinks

_ROWS_A_LIST = 500
_FOLDERS = 32  # of list documents, one file each; the driver lists up to 32 folders without a job
_HEAD = ", ".join(cdx.HEADER)


def _written_lists(s, d) -> str:
    """The captures as index list documents of some rows each, every third with a resume key."""
    path = shared_folder(s, "lists")
    rows = table(s, d, "captures").select(F.floor(c("capture_id") / _ROWS_A_LIST).alias("doc"), F.to_json(F.array(*cdx.HEADER)).alias("r"))
    docs = rows.groupBy("doc").agg(F.array_join(F.collect_list("r"), ",").alias("rows"))  # as many rows as a document has
    key = F.when(c("doc") % 3 == 0, F.concat(F.lit(",[],"), F.to_json(F.array(F.concat(F.lit("key "), "doc"))))).otherwise("")
    text = F.concat(F.lit("["), F.to_json(F.array(*map(F.lit, cdx.HEADER))), F.lit(","), "rows", key, F.lit("]"))
    folder = F.pmod("doc", F.lit(_FOLDERS)).alias("folder")
    docs.select(folder, text.alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path, compression="gzip")
    return path


@query(f"SELECT {_HEAD}, count(*) AS n FROM captures GROUP BY ALL")
def src1_index_lists(s, d):
    return lists.index_lists(s, _written_lists(s, d), pattern="*.txt.gz").groupBy(*cdx.HEADER).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT 'key ' || (capture_id // {_ROWS_A_LIST}) AS resume_key FROM captures WHERE (capture_id // {_ROWS_A_LIST}) % 3 = 0")
def src2_resume_keys(s, d):
    return lists.resume_keys(s, _written_lists(s, d), "*.txt.gz").select("resume_key")


_FIELD = "coalesce(nullif(regexp_replace({0}, '[ \\n\\r]', '_', 'g'), ''), '-')"


@query("SELECT capture_id // 500 AS doc, " + ", ".join(f"{_FIELD.format(n)} AS {n}" for n in cdx.HEADER) + " FROM captures")
def src13_classic_rows(s, d):
    fields = [F.coalesce(F.nullif(F.regexp_replace(n, "[ \\n\\r]", "_"), F.lit("")), F.lit("-")) for n in cdx.HEADER]
    rows = table(s, d, "captures").select(F.floor(c("capture_id") / _ROWS_A_LIST).alias("doc"), F.concat_ws(" ", *fields).alias("line"))
    texts = rows.groupBy("doc").agg(F.array_join(F.collect_list("line"), "\n").alias("value"))
    return lists.classic_rows(texts.select(c("doc").alias("path"), F.concat("value", F.lit("\n\nresume+key")).alias("value"))).select(c("path").alias("doc"), *cdx.HEADER)


@query(
    f"SELECT url, CASE WHEN {q.real('timestamp')} THEN try_strptime(timestamp, '%Y%m%d%H%M%S') END AS ts, expected_digest, CASE WHEN NOT {q.real('timestamp')} THEN 'timestamp' WHEN NOT {q.is_digest('expected_digest')} THEN 'digest' END AS fault, count(*) AS n "
    "FROM (SELECT nullif(url, '') AS url, timestamp, nullif(expected_digest, '') AS expected_digest FROM download_results) GROUP BY ALL"
)
def src15_snk8_download_queue(s, d):
    path = shared_folder(s, "queue")
    empty = lambda name: F.nullif(c(name), F.lit("")).alias(name)
    logs.write_headerless(table(s, d, "download_results").select(empty("url"), empty("timestamp"), empty("expected_digest")), path, ["url", "timestamp", "expected_digest"])
    return lists.download_queue(s, path, "report").groupBy("url", c("ts").cast("timestamp_ntz").alias("ts"), "expected_digest", "fault").agg(F.count("*").alias("n"))


@query(f"SELECT digest, {q.is_digest('digest')} AS valid, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(digest, '^\\s+', ''), '\\s+$', '') AS digest FROM resolutions) WHERE digest <> '' GROUP BY ALL")
def src16_digest_list(s, d):
    path = shared_folder(s, "digests")
    table(s, d, "resolutions").where("digest is not null").select("digest").write.text(path)
    return lists.digest_list(s, path).groupBy("digest", "valid").agg(F.count("*").alias("n"))


@query("SELECT name, CASE WHEN NOT regexp_full_match(name, '[A-Za-z0-9_]+') THEN 'screen_name' END AS fault, count(*) AS n FROM (SELECT regexp_extract(url, '^https?://[^/]+/([^/\\s]+)', 1) AS name FROM resolutions WHERE url IS NOT NULL) WHERE name <> '' GROUP BY ALL")
def src17_screen_names(s, d):
    path = shared_folder(s, "names")
    table(s, d, "resolutions").select(F.regexp_extract("url", r"^https?://[^/]+/([^/\s]+)", 1).alias("name")).where("name <> ''").write.text(path)
    return lists.screen_names(s, path, "report").groupBy("name", "fault").agg(F.count("*").alias("n"))


@query("SELECT digest, url, CASE WHEN NOT starts_with(url, 'https://') THEN 'url' END AS fault, count(*) AS n FROM (SELECT nullif(digest, '') AS digest, nullif(url, '') AS url FROM snapshots) GROUP BY ALL")
def src21_snk9_digest_urls(s, d):
    path = shared_folder(s, "urls")
    logs.write_headerless(table(s, d, "snapshots").select(F.nullif("digest", F.lit("")).alias("digest"), F.nullif("url", F.lit("")).alias("url")), path, ["digest", "url"])
    raw = lists.digest_urls(s, path, "https://", "report")
    return raw.groupBy("digest", "url", "fault").agg(F.count("*").alias("n"))


@query(f"WITH {q.LOG} SELECT observed, nullif(url, '') AS url, archive_ts, nullif(expected_digest, '') AS expected_digest, actual_digest, count(*) AS n FROM log WHERE {q.is_digest('actual_digest')} GROUP BY ALL")
def src19_snk7_csv_log(s, d):
    path = shared_folder(s, "log")
    rows = log(s, d).withColumns({n: F.nullif(n, F.lit("")) for n in ("url", "expected_digest")})
    logs.write_csv_log(rows, rows.where("url is not null"), path)
    return logs.csv_log(s, path)[0].groupBy("observed", "url", "archive_ts", "expected_digest", "actual_digest").agg(F.count("*").alias("n"))


@query(f"SELECT {q.b32('content')} AS digest, min(octet_length(encode(content))) AS bytes, true AS ok FROM snapshots WHERE content IS NOT NULL GROUP BY 1")
def src8_snk6_digest_files(s, d):
    path = shared_folder(s, "store")
    rows = table(s, d, "snapshots").where("content is not null").select(digest.sha1_base32(c("content")).alias("digest"), "content").dropDuplicates(["digest"])
    sinks.export_bytes(rows, path).agg(F.count("*")).collect()
    found = files.digest_files(s, path)
    return found.select("digest", F.length("content").alias("bytes"), (digest.sha1_base32(c("content")) == c("digest")).alias("ok"))


@query(f"SELECT {q.b32('content')} AS digest, min(regexp_replace(content, '[\\n\\r]', ' ', 'g')) AS line FROM snapshots WHERE content IS NOT NULL GROUP BY 1")
def src4_src5_snk3_snk4_zstd_lines(s, d):
    path = shared_folder(s, "lines")
    rows = table(s, d, "snapshots").where("content is not null").select(digest.sha1_base32(c("content")).alias("digest"), F.regexp_replace("content", "[\\n\\r]", " ").alias("line"))
    rows = rows.withColumn("line", F.concat("digest", "line"))
    written = [r.file for r in sinks.write_snapshot_files(rows, path, files=8).collect()]  # one row per file
    read = files.numbered_lines(s, sorted(written))
    return read.select(F.substring("line", 1, 32).alias("digest"), F.expr("substring(line, 33)").alias("line"))


@query("SELECT json_object('rows', count(*), 'digests', count(DISTINCT digest), 'dated', count(timestamp)) AS summary FROM snapshots")
def snk11_summary(s, d):
    t = table(s, d, "snapshots")
    return sinks.summary_json(t.agg(F.count("*").alias("rows"), F.countDistinct("digest").alias("digests"), F.count("timestamp").alias("dated")))


@query("SELECT snap_id, true AS same_text, true AS same_bytes, (snap_id % 9 + 1)::INT AS level_at_most FROM snapshots WHERE content IS NOT NULL")
def z1_z2_z4_z6_gzip_round_trip(s, d):
    """Contents as gzip archives of all levels: text, bytes by the detected settings, and a level no higher than the one used."""
    level = F.pmod(c("snap_id"), F.lit(9)) + 1
    given = F.concat(F.lit('{"type":"gzip","compressor":"zlib","level":'), level, F.lit(',"mtime":'), c("snap_id") % 1000, F.lit(',"os":3}'))
    packed = table(s, d, "snapshots").where("content is not null").select("snap_id", "content", gzipformat.encoded(c("content"), given).alias("archive"))
    told = packed.select("snap_id", "content", "archive", gzipformat.detected(c("archive")).alias("found"), gzipformat.decompressed(c("archive")).alias("text"))
    again = told.select("snap_id", (c("text") == c("content")).alias("same_text"), (gzipformat.encoded(c("content"), c("found")) == c("archive")).alias("same_bytes"), F.get_json_object("found", "$.level").cast("int").alias("level"))
    used = (F.pmod(c("snap_id"), F.lit(9)) + 1).cast("int")
    return again.select("snap_id", "same_text", "same_bytes", F.when(c("level") <= used, used).alias("level_at_most"))
