"""Queries for the archive operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import cdx, digest, snapshot, surt, times, urls
from cairn.operators import archive
from cairn.plans import sqltext as q
from cairn.session import table

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def cap(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "captures")
    return t.select("capture_id", "urlkey", c("timestamp").alias("stamp"), F.when(times.is_real(c("timestamp")), c("timestamp")).alias("ts"), c("original").alias("url"), "mimetype", "statuscode", "digest", "length", c("seen_at").cast("timestamp").alias("seen_at"))


def snap(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "snapshots").select("snap_id", "digest", "expected_digest", F.when(times.is_real(c("timestamp")), c("timestamp")).alias("ts"), "url", "format", "content")


def log(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "download_results").where("actual_digest is not null")
    return t.select("result_id", "url", c("timestamp").alias("archive_ts"), "expected_digest", "actual_digest", times.to_unix(c("received_at").cast("timestamp")).alias("observed"))


def lines(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "raw_lines").where("kind = 'snapshot'")
    return t.select("line_id", "file_name", "line_no", F.regexp_replace("line", r"\r\z", "").alias("line"))


def copy(s: SparkSession, d: str, side: str) -> DataFrame:
    t = table(s, d, f"merge_{side}").where("digest is not null")
    return archive.one_per_digest(t.select(digest.clean(c("digest")).alias("digest"), c(f"{side}_value").alias("line"), c(f"{side}_line_number").alias("n")), "n")


# Scalar functions -------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {q.b32('text')} AS digest FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def d1_sha1_b32(s, d):
    return table(s, d, "documents").select("doc_id", digest.sha1_base32(c("text")).alias("digest"))


@query(
    f"SELECT capture_id, digest, {q.is_digest('digest')} AS valid, CASE WHEN {q.is_digest('digest')} THEN array_to_string(list_transform(range(0, 4), lambda g: printf('%010X', list_sum(list_transform(range(0, 8), "
    f"lambda j: (instr('{digest.ALPHABET}', substr(digest, g * 8 + j + 1, 1)) - 1) * (1::BIGINT << (5 * (7 - j))::INT)))::BIGINT)), '') END AS bytes FROM captures"
)
def d2_d3_digest_parse(s, d):
    return table(s, d, "captures").select("capture_id", "digest", digest.is_digest(c("digest")).alias("valid"), F.hex(digest.digest_bytes(c("digest"))).alias("bytes"))


@query(f"WITH k AS (SELECT urlkey, {q.order_key('digest')} AS k, digest FROM captures) SELECT urlkey, arg_min(digest, k) AS least, arg_max(digest, k) AS most FROM k WHERE k IS NOT NULL GROUP BY 1")
def d4_digest_order(s, d):
    t = table(s, d, "captures").where(digest.is_digest(c("digest")))
    key = digest.digest_bytes(c("digest"))
    return t.groupBy("urlkey").agg(F.min_by("digest", key).alias("least"), F.max_by("digest", key).alias("most"))


@query(f"SELECT capture_id, {q.real('timestamp')} AS valid, CASE WHEN {q.real('timestamp')} THEN epoch(try_strptime(timestamp, '%Y%m%d%H%M%S'))::BIGINT END AS seconds FROM captures")
def t1_ts_parse(s, d):
    return table(s, d, "captures").select("capture_id", times.is_real(c("timestamp")).alias("valid"), times.to_unix(times.parse(c("timestamp"))).alias("seconds"))


@query("SELECT capture_id, strftime(seen_at, '%Y%m%d%H%M%S') AS stamp, epoch(date_trunc('second', seen_at))::BIGINT AS seconds, true AS same, floor(epoch_us(seen_at) / 1000000.0)::BIGINT AS observed FROM captures")
def t2_t3_ts_round_trip(s, d):
    t = cap(s, d).select("capture_id", times.text_of(c("seen_at")).alias("stamp"), times.to_unix(c("seen_at")).alias("seconds"), "seen_at")
    same = times.text_of(times.from_unix(c("seconds"))) == c("stamp")
    return t.select("capture_id", "stamp", "seconds", same.alias("same"), times.observed_second(c("seen_at")).alias("observed"))


@query(f"SELECT capture_id, {q.surt('original')} AS surt, coalesce({q.surt('original')} = urlkey, false) AS same FROM captures")
def s1_surt_from_url(s, d):
    key = surt.from_url(c("original"))
    return table(s, d, "captures").select("capture_id", key.alias("surt"), F.coalesce(key == c("urlkey"), F.lit(False)).alias("same"))


@query(
    f"WITH k AS (SELECT DISTINCT urlkey FROM captures), p AS (SELECT urlkey, {q.IS_KEY} AS valid, CASE WHEN {q.IS_KEY} THEN string_split(split_part(urlkey, ')', 1), ',') END AS l, CASE WHEN {q.IS_KEY} THEN regexp_replace(urlkey, '^[^)]*\\)', '') END AS path FROM k) "
    "SELECT urlkey, valid, array_to_string(l, '/') AS labels, array_to_string(list_reverse(l), '/') AS reversed, path, 'https://' || array_to_string(list_transform(list_reverse(l), lambda x: split_part(x, ':', 1)), '.') || CASE WHEN contains(l[-1], ':') THEN ':' || regexp_replace(l[-1], '^[^:]*:', '') ELSE '' END || path AS canonical FROM p"
)
def s2_s5_surt_parts(s, d):
    k = table(s, d, "captures").select("urlkey").distinct()
    return k.select("urlkey", surt.is_key(c("urlkey")).alias("valid"), F.array_join(surt.labels(c("urlkey")), "/").alias("labels"), F.array_join(F.reverse(surt.labels(c("urlkey"))), "/").alias("reversed"), surt.path(c("urlkey")).alias("path"), surt.canonical_url(c("urlkey")).alias("canonical"))


@query(f"SELECT count(*) FILTER (coalesce({q.surt('original')} = urlkey, false)) AS good, count(*) FILTER (NOT coalesce({q.surt('original')} = urlkey, false)) AS bad FROM captures WHERE mimetype = 'application/json'")
def s6_check_surts(s, d):
    same = F.coalesce(surt.from_url(c("original")) == c("urlkey"), F.lit(False))
    return table(s, d, "captures").where("mimetype = 'application/json'").agg(F.count_if(same).alias("good"), F.count_if(~same).alias("bad"))


@query(f"WITH u AS (SELECT DISTINCT original FROM captures), p AS (SELECT original, '<html><body>You are being <a href=\"' || original || '\">redirected</a>.</body></html>' AS page FROM u) SELECT original, page, CASE WHEN contains(original, '\"') OR original = '' THEN NULL ELSE original END AS target, {q.b32('page')} AS digest, true AS fits FROM p")
def r1_r3_redirect_pages(s, d):
    u = table(s, d, "captures").select("original").distinct().withColumn("page", urls.redirect_page(c("original")))
    name = digest.sha1_base32(c("page"))
    return u.select("original", "page", urls.redirect_target(c("page")).alias("target"), name.alias("digest"), urls.redirect_fits(c("original"), name).alias("fits"))


@query(
    f"WITH u AS (SELECT capture_id, 'http' || CASE WHEN capture_id % 2 = 0 THEN 's' ELSE '' END || '://web.archive.org/web/' || timestamp || CASE capture_id % 3 WHEN 0 THEN 'id_/' WHEN 1 THEN '/' ELSE 'im/' END || original AS url, timestamp, original FROM captures) "
    f"SELECT capture_id, CASE WHEN capture_id % 3 < 2 AND {q.real('timestamp')} THEN timestamp END AS ts, CASE WHEN capture_id % 3 < 2 AND {q.real('timestamp')} THEN original END AS target, 'https://web.archive.org/web/' || timestamp || 'id_/' || original AS rendered, 'http://base.test/web/' || timestamp || 'if_/' || original AS request FROM u"
)
def w1_w3_replay_urls(s, d):
    t = table(s, d, "captures")
    https = F.when(c("capture_id") % 2 == 0, "s").otherwise("")
    flag = F.when(c("capture_id") % 3 == 0, "id_/").when(c("capture_id") % 3 == 1, "/").otherwise("im/")
    u = t.withColumn("u", F.concat(F.lit("http"), https, F.lit("://web.archive.org/web/"), "timestamp", flag, "original"))
    return u.select("capture_id", times.text_of(urls.replay_time(c("u"))).alias("ts"), urls.replay_target(c("u")).alias("target"), urls.replay_url(c("timestamp"), c("original")).alias("rendered"), urls.request_url(F.lit("http://base.test/"), c("timestamp"), c("original"), original=False).alias("request"))


@query("WITH u AS (SELECT DISTINCT urlkey FROM captures) SELECT urlkey, 'https://base.test/cdx?url=' || url_encode(urlkey) || '&matchType=prefix&fastLatest=false&limit=10&showResumeKey=true&gzip=false&resumeKey=' || url_encode(urlkey) AS request, urlkey AS resume_key FROM u")
def w4_w5_index_requests(s, d):
    u = table(s, d, "captures").select("urlkey").distinct()
    answer = F.concat(F.lit("a b c\n\n"), F.url_encode(c("urlkey")), F.lit("\n"))
    return u.select("urlkey", urls.query_url("https://base.test/cdx", c("urlkey"), "prefix", False, 10, True, c("urlkey")).alias("request"), urls.resume_key(answer).alias("resume_key"))


_CODES = ", ".join(f"'{x}'" for x in cdx.STATUS_CODES)
_PROXY = ", ".join(f"'{x}'" for x in cdx.CLOUDFLARE)


@query(
    f"SELECT capture_id, CASE WHEN statuscode = '-' THEN 0 WHEN statuscode IN ({_CODES}) THEN statuscode::INT END AS status, CASE WHEN statuscode = '-' THEN 200 WHEN statuscode IN ({_PROXY}) THEN 500 WHEN statuscode IN ({_CODES}) THEN statuscode::INT END AS logical, "
    f"CASE WHEN statuscode = '-' OR statuscode IN ({_CODES}) THEN statuscode END AS again, nullif(mimetype, '-') AS mime, CASE WHEN regexp_full_match(length, '[-+]?[0-9]+') THEN TRY_CAST(length AS BIGINT) END AS length, coalesce(length <> '-' AND (NOT regexp_full_match(length, '[-+]?[0-9]+') OR TRY_CAST(length AS BIGINT) IS NULL), false) AS length_fault FROM captures"
)
def c1_c5_record_fields(s, d):
    t = table(s, d, "captures")
    return t.select("capture_id", cdx.status_value(c("statuscode")).alias("status"), cdx.status_logical(c("statuscode")).alias("logical"), cdx.status_text(cdx.status_value(c("statuscode"))).alias("again"), cdx.dash_to_null(c("mimetype")).alias("mime"), cdx.length_value(c("length")).alias("length"), cdx.length_fault(c("length")).alias("length_fault"))


_PARTS = ", ".join(f"CASE WHEN good THEN nullif({p}, '') END AS {p}" for p in snapshot.PARTS)


@query(f"WITH {q.LINES} SELECT line_id, good, {_PARTS} FROM parsed")
def e1_snapshot_parse(s, d):
    t = lines(s, d).withColumn("p", snapshot.parse(c("line")))
    return t.select("line_id", c("p").isNotNull().alias("good"), *[F.nullif(c(f"p.{p}"), F.lit("")).alias(p) for p in snapshot.PARTS])


@query(f"SELECT snap_id, regexp_extract(content, '[\\r\\n \\t]*$') AS own, coalesce({q.json_text('format', '$.closing_whitespace')}, chr(10)) AS effective, {q.verify('digest', 'content', 'format', 'chr(10)')} AS state FROM snapshots")
def e2_e5_snapshot_verify(s, d):
    t = table(s, d, "snapshots")
    return t.select("snap_id", F.regexp_extract("content", snapshot.WHITESPACE, 0).alias("own"), snapshot.effective_whitespace(c("format"), "\n").alias("effective"), snapshot.verify(c("digest"), c("content"), c("format"), "\n").alias("state"))


@query(r"WITH t AS (SELECT doc_id, regexp_replace(text, '[\r\n \t]+$', '') AS content, regexp_extract(text, '([\r\n \t]*)$', 1) AS space FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha1(content) AS content_sha1, replace(replace(replace(space, chr(13), '\r'), chr(10), '\n'), chr(9), '\t') AS space, CASE WHEN regexp_matches(content, '[\r\n]') THEN 'internal_line_break' END AS fault FROM t")
def e6_e10_unprocessed(s, d):
    t = table(s, d, "documents").where("text is not null").withColumn("u", snapshot.unprocessed(c("text")))
    return t.select("doc_id", F.sha1("u.content").alias("content_sha1"), snapshot.escaped_whitespace(c("u.space")).alias("space"), c("u.fault").alias("fault"))


@query(
    f"WITH {q.SNAP} SELECT snap_id, CASE WHEN NOT coalesce(regexp_matches(expected_digest, '[\"\\\\\\x00-\\x1f]'), false) AND NOT coalesce(regexp_matches(url, '[\"\\\\\\x00-\\x1f]'), false) THEN '{{\"digest\":\"' || digest || '\",' || coalesce('\"expected_digest\":\"' || expected_digest || '\",', '') || coalesce('\"timestamp\":\"' || ts || '\",', '') || coalesce('\"url\":\"' || url || '\",', '') || coalesce('\"format\":' || format || ',', '') || '\"content\":' || content || '}}' END AS line FROM snap"
)
def e9_e11_snapshot_render(s, d):
    return snap(s, d).select("snap_id", snapshot.render(c("digest"), c("expected_digest"), c("ts"), c("url"), c("format"), c("content")).alias("line"))


@query(
    f"WITH {q.LINES}, f AS (SELECT file_name, line_no, content, digest, row_number() OVER (PARTITION BY file_name ORDER BY line_no) AS r FROM parsed WHERE good AND format = ''), v AS (SELECT file_name, "
    + ", ".join(f"bool_and({q.b32(f'(content || {w})')} = digest) AS w{i}" for i, w in enumerate(("chr(10)", "chr(13) || chr(10)", "chr(13) || chr(13) || chr(10)")))
    + " FROM f WHERE r <= 8 GROUP BY 1) SELECT file_name, CASE WHEN w0 THEN 'LF' WHEN w1 THEN 'CRLF' WHEN w2 THEN 'CRCRLF' END AS whitespace FROM v"
)
def e7_g11_infer_context(s, d):
    p = lines(s, d).withColumn("p", snapshot.parse(c("line"))).where("p is not null and p.format is null").select("file_name", "line_no", "p.*")
    first = p.withColumn("r", F.row_number().over(W.partitionBy("file_name").orderBy("line_no"))).where("r <= 8")
    fits = [F.bool_and(digest.sha1_base32(F.concat("content", F.lit(w))) == c("digest")).alias(f"w{i}") for i, w in enumerate(snapshot.CANDIDATES)]
    return first.groupBy("file_name").agg(*fits).select("file_name", F.when(c("w0"), "LF").when(c("w1"), "CRLF").when(c("w2"), "CRCRLF").alias("whitespace"))


@query(
    "WITH j AS (SELECT snap_id, CASE WHEN json_valid(content) THEN content::JSON END AS j FROM snapshots), p AS (SELECT snap_id, CASE WHEN json_type(j, '$.data') = 'OBJECT' THEN 'o' WHEN json_type(j, '$.data') IS NOT NULL THEN 'x' END AS k, "
    "CASE WHEN json_type(j, '$.data.id') = 'VARCHAR' THEN j->>'$.data.id' END AS id, CASE WHEN json_type(j, '$.data.author_id') = 'VARCHAR' THEN j->>'$.data.author_id' END AS a, from_json(j->'$.includes.users', '[{\"id\":\"VARCHAR\",\"username\":\"VARCHAR\"}]') AS u FROM j) "
    "SELECT snap_id, CASE WHEN k = 'o' THEN 'https://twitter.com/' || (list_filter(u, lambda x: x.id = a)[1]).username || '/status/' || id END AS url FROM p"
)
def e8_infer_url(s, d):
    return table(s, d, "snapshots").select("snap_id", snapshot.inferred_url(c("content")).alias("url"))


@query("SELECT k, CASE WHEN k < 4 THEN 60000 * (1::BIGINT << k::INT) ELSE 600000 END AS bound_ms FROM range(0, 7) t(k)")
def x1_retry_bounds(s, d):
    return s.range(1).select(F.posexplode(urls.retry_bounds(60_000, 600_000, 7)).alias("k", "bound_ms")).select(c("k").cast("bigint").alias("k"), "bound_ms")


@query("SELECT result_id, coalesce(error_type IN ('timeout', 'body', 'connect', 'request'), false) OR coalesce(TRY_CAST(error_type AS INT) = 429 OR TRY_CAST(error_type AS INT) BETWEEN 500 AND 599, false) AS again FROM download_results")
def x2_retryable(s, d):
    status = c("error_type").try_cast("int")
    return table(s, d, "download_results").select("result_id", urls.retryable(status, F.lit(None).cast("string"), c("error_type")).alias("again"))


@query(f"SELECT doc_id, substr(n, 1, 2) || '/' || substr(n, 3, 2) || '/' || n || '.zst' AS path FROM (SELECT doc_id, {q.b32('text')} AS n FROM documents WHERE text IS NOT NULL)")
def x3_store_path(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", urls.store_path(digest.sha1_base32(c("text")), (2, 2), ".zst").alias("path"))


# Projections and filters ------------------------------------------------------------------------------------------


@query(f"WITH {q.SNAP} SELECT snap_id, digest FROM snap WHERE ts IS NULL")
def incomplete_snapshots(s, d):
    return snap(s, d).where("ts is null").select("snap_id", "digest")


@query(f"WITH {q.SNAP} SELECT snap_id, (ts IS NOT NULL OR url IS NOT NULL OR expected_digest IS NOT NULL) AS has_metadata, coalesce({q.json_text('format', '$.closing_whitespace')} IS NOT NULL, false) AS has_whitespace, strlen(content) AS size FROM snap")
def snapshot_predicates(s, d):
    has = c("ts").isNotNull() | c("url").isNotNull() | c("expected_digest").isNotNull()
    return snap(s, d).select("snap_id", has.alias("has_metadata"), F.get_json_object("format", "$.closing_whitespace").isNotNull().alias("has_whitespace"), F.octet_length("content").cast("bigint").alias("size"))


@query("SELECT file_id, path FROM small_files WHERE starts_with(body, '{\"digest\":\"A')")
def find_prefix(s, d):
    return table(s, d, "small_files").where(c("body").startswith('{"digest":"A')).select("file_id", "path")


@query("SELECT urlkey, timestamp, capture_id FROM captures WHERE starts_with(urlkey, 'example,')")
def surt_prefix_scan(s, d):
    return table(s, d, "captures").where(c("urlkey").startswith("example,")).select("urlkey", "timestamp", "capture_id")


@query("SELECT urlkey, timestamp, count(*) AS n FROM captures WHERE urlkey = 'example,chirp)/home/latest' GROUP BY ALL")
def index_point_get(s, d):
    return table(s, d, "captures").where("urlkey = 'example,chirp)/home/latest'").groupBy("urlkey", "timestamp").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS items, count(DISTINCT urlkey) AS keys FROM captures")
def index_stats(s, d):
    return table(s, d, "captures").agg(F.count("*").alias("items"), F.count_distinct("urlkey").alias("keys"))


@query(f"WITH {q.CAP} SELECT capture_id, CASE WHEN contains(urlkey, chr(0)) THEN 'surt_nul' WHEN epoch(try_strptime(ts, '%Y%m%d%H%M%S')) < 0 THEN 'negative_timestamp' WHEN strlen(url) > 65535 THEN 'url_too_long' WHEN strlen(mimetype) > 65535 THEN 'mime_type_too_long' WHEN NOT {q.is_digest('digest')} AND strlen(digest) > 65535 THEN 'digest_too_long' END AS reason FROM cap")
def item_validation(s, d):
    seconds = times.to_unix(times.parse(c("ts")))
    return cap(s, d).select("capture_id", cdx.item_fault(c("urlkey"), seconds, c("url"), c("mimetype"), c("digest"), digest.is_digest(c("digest"))).alias("reason"))


@query("SELECT path, 'rm ' || CASE WHEN starts_with(path, '-') THEN '-- ' ELSE '' END || path AS command FROM small_files WHERE size_bytes = 0 AND regexp_full_match(path, '[A-Za-z0-9_./-]+') UNION ALL SELECT path, 'rm ' || '$''' || replace(replace(path, '\\', '\\\\'), '''', '\\''') || '''' FROM small_files WHERE size_bytes = 0 AND NOT regexp_full_match(path, '[A-Za-z0-9_./-]+')")
def remove_script(s, d):
    plain = c("path").rlike(r"\A[A-Za-z0-9_./-]+\z")
    quoted = F.concat(F.lit("$'"), F.replace(F.replace(c("path"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    command = F.when(plain, F.concat(F.lit("rm "), F.when(c("path").startswith("-"), "-- ").otherwise(""), c("path"))).otherwise(F.concat(F.lit("rm "), quoted))
    return table(s, d, "small_files").where("size_bytes = 0").select("path", command.alias("command"))
