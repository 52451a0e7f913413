"""Queries for joins, set operations, aggregates, ordering checks and state, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import cdx, digest, snapshot, times
from cairn.operators import archive, pipelines
from cairn.plans import archive_queries
from cairn.plans import sqltext as q
from cairn.plans.archive_queries import c, cap, copy, lines, log, query, snap
from cairn.session import table

_TARGETS = "targets AS (SELECT DISTINCT digest FROM (SELECT digest FROM captures UNION ALL SELECT actual_digest FROM log UNION ALL SELECT digest FROM snapshots) WHERE digest IS NOT NULL)"
_RESOLVED = (
    f"own AS (SELECT f.digest, f.ts, f.url, f.others FROM targets JOIN first_cap f USING (digest)), declared AS (SELECT DISTINCT l.actual_digest AS digest, l.expected_digest FROM log l JOIN targets t ON t.digest = l.actual_digest WHERE l.actual_digest NOT IN (SELECT digest FROM own)), "
    f"via AS (SELECT d.digest, f.ts, f.url, d.expected_digest, f.others, row_number() OVER (PARTITION BY d.digest ORDER BY f.ts, f.url, {q.order_key('d.expected_digest')} IS NULL, coalesce({q.order_key('d.expected_digest')}, d.expected_digest)) AS r, sum(f.others + 1) OVER (PARTITION BY d.digest) - 1 AS rest FROM declared d JOIN first_cap f ON f.digest = d.expected_digest), "
    "resolved AS (SELECT digest, ts, url, NULL::VARCHAR AS expected_digest, others::BIGINT AS others FROM own UNION ALL SELECT digest, ts, url, expected_digest, rest::BIGINT FROM via WHERE r = 1)"
)
_BASE = f"WITH {q.CAP}, {q.LOG}, {q.EARLIEST}, {_TARGETS}, {_RESOLVED}"


def targets(s, d):
    parts = table(s, d, "captures").select("digest"), log(s, d).select(c("actual_digest").alias("digest")), table(s, d, "snapshots").select("digest")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("digest is not null").distinct()


def resolved(s, d):
    return archive.resolve(targets(s, d), cap(s, d), log(s, d))


@query(f"WITH {q.CAP}, {q.EARLIEST} SELECT * FROM first_cap")
def a1_a4_earliest_capture(s, d):
    return archive.earliest_captures(cap(s, d))


@query(f"WITH {q.CAP} SELECT DISTINCT digest, ts, url FROM cap WHERE digest IS NOT NULL AND ts IS NOT NULL")
def a3_j12_captures_by_digest(s, d):
    return archive.distinct_captures(cap(s, d))


@query(f"WITH {q.CAP} SELECT digest, count(*) AS n, CASE WHEN count(*) <= 10 THEN string_agg(ts || ' ' || url, chr(10) ORDER BY ts, url) END AS captures FROM (SELECT DISTINCT digest, ts, url FROM cap WHERE digest IS NOT NULL AND ts IS NOT NULL) GROUP BY 1")
def a3_j11_capture_lists(s, d):
    t = archive.captures_by_digest(cap(s, d), most=10)
    return t.select("digest", "n", F.array_join(F.transform("captures", lambda x: F.concat(x["ts"], F.lit(" "), x["url"])), "\n").alias("captures"))


@query(f"{_BASE} SELECT * FROM resolved")
def j6_j7_a2_resolve(s, d):
    return resolved(s, d)


@query(f"{_BASE} SELECT digest FROM targets WHERE digest NOT IN (SELECT digest FROM resolved)")
def j8_resolve_missing(s, d):
    return archive.missing(targets(s, d), cap(s, d), log(s, d))


_COULD = "could AS (SELECT r.digest, NULL::VARCHAR AS expected_digest, k.ts, k.url, r.expected_digest AS e0, r.ts AS t0, r.url AS u0 FROM resolved r JOIN distinct_cap k USING (digest) WHERE r.expected_digest IS NULL UNION ALL SELECT r.digest, l.expected_digest, k.ts, k.url, r.expected_digest, r.ts, r.url FROM resolved r JOIN declared l USING (digest) JOIN distinct_cap k ON k.digest = l.expected_digest WHERE r.expected_digest IS NOT NULL)"


@query(f"{_BASE}, {_COULD} SELECT digest, expected_digest, ts, url FROM could WHERE expected_digest IS DISTINCT FROM e0 OR ts IS DISTINCT FROM t0 OR url IS DISTINCT FROM u0")
def a1_a2_snk10_unused_captures(s, d):
    return archive.unused_captures(targets(s, d), cap(s, d), log(s, d))


@query(f"{_BASE} SELECT digest, others FROM resolved WHERE others > 0")
def snk10_resolve_warnings(s, d):
    return resolved(s, d).where("others > 0").select("digest", "others")


_ENHANCED = (
    f"WITH {q.CAP}, {q.LOG}, {q.SNAP}, {q.EARLIEST}, last AS (SELECT actual_digest AS digest, arg_max(expected_digest, row(observed, expected_digest)) AS logged FROM log WHERE {q.is_digest('expected_digest')} GROUP BY 1), "
    f"o AS (SELECT s.*, a.ts AS ts1, a.url AS url1, CASE WHEN {q.is_digest('s.expected_digest')} THEN s.expected_digest ELSE l.logged END AS bydig FROM snap s LEFT JOIN first_cap a USING (digest) LEFT JOIN last l USING (digest) WHERE s.ts IS NULL), "
    "e AS (SELECT o.snap_id, o.digest, CASE WHEN ts1 IS NULL AND b.ts IS NOT NULL THEN bydig WHEN ts1 IS NULL THEN o.expected_digest END AS expected_digest, coalesce(ts1, b.ts) AS ts, coalesce(url1, b.url, o.url) AS url, CASE WHEN coalesce(ts1, b.ts) IS NULL THEN 'unmatched' ELSE 'enhanced' END AS outcome FROM o LEFT JOIN first_cap b ON b.digest = bydig "
    "UNION ALL SELECT snap_id, digest, expected_digest, ts, url, 'already' FROM snap WHERE ts IS NOT NULL)"
)


@query(f"{_ENHANCED} SELECT * FROM e")
def j9_l3_enhance(s, d):
    return archive.enhance(snap(s, d), cap(s, d), log(s, d))


@query(f"{_ENHANCED} SELECT outcome, count(*) AS n FROM e GROUP BY 1")
def a5_enhance_summary(s, d):
    return j9_l3_enhance(s, d).groupBy("outcome").agg(F.count("*").alias("n"))


_PAIR = f"WITH {q.FIRST}, {q.SECOND}, m AS (SELECT coalesce(a.digest, b.digest) AS digest, CASE WHEN b.line IS NULL THEN 'first' WHEN a.line IS NULL THEN 'second' WHEN a.line = b.line THEN 'match' ELSE 'collision' END AS source, CASE WHEN b.line IS NULL OR strlen(a.line) < strlen(b.line) THEN a.line ELSE b.line END AS line FROM first a FULL JOIN second b ON a.digest = b.digest)"


@query(f"{_PAIR} SELECT * FROM m")
def j1_l5_merge_pair(s, d):
    return archive.merge_pair(copy(s, d, "first"), copy(s, d, "second"))


@query(f"{_PAIR} SELECT source, count(*) AS n, sum(strlen(line))::BIGINT AS bytes FROM m GROUP BY 1")
def j2_merge_summary(s, d):
    return j1_l5_merge_pair(s, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).cast("bigint").alias("bytes"))


@query(f"WITH {q.LINES} SELECT line_id, NOT regexp_matches(line, '^\\{{\"digest\":\"[A-Z2-7]{{32}}') AS bad_start FROM lines WHERE NOT regexp_matches(line, '^\\{{\"digest\":\"[A-Z2-7]{{32}}')")
def j3_merge_errors(s, d):
    bad = ~c("line").rlike('^\\{"digest":"[A-Z2-7]{32}')
    return lines(s, d).where(bad).select("line_id", bad.alias("bad_start"))


_SIDES = " UNION ALL ".join(f"SELECT '{x}' AS side, {x}_line_number AS line_number, {x}_value AS line FROM merge_{x}" for x in ("first", "second"))


@query(
    f"WITH s AS ({_SIDES}), e AS (SELECT *, nullif(regexp_extract(line, '^\\{{\"digest\":\"([A-Z2-7]{{32}})', 1), '') AS digest FROM s), k AS (SELECT *, {q.order_key('digest')} AS k FROM e), "
    "b AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY side ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k) "
    "SELECT side, line_number, CASE WHEN k IS NULL THEN 'invalid_line' WHEN k = before THEN 'duplicate' ELSE 'out_of_order' END AS reason, digest, CASE WHEN k IS NULL THEN line END AS line FROM b WHERE k IS NULL OR k <= before"
)
def j3_g5_merge_input_errors(s, d):
    sides = [table(s, d, f"merge_{x}").select(c(f"{x}_line_number").alias("line_number"), c(f"{x}_value").alias("line")) for x in ("first", "second")]
    return archive.merge_errors(*sides)


_DUAL = (
    f"WITH {q.FIRST}, {q.SECOND}, new AS (SELECT DISTINCT digest, CASE WHEN min(content) LIKE '{{\"data\":{{%' THEN 'first' WHEN min(content) LIKE '{{\"data\":[%' THEN 'second' ELSE 'skip' END AS target FROM snapshots GROUP BY digest), "
    "m AS (SELECT 'first' AS target, digest, 'existing' AS origin FROM first UNION ALL SELECT 'second', digest, 'existing' FROM second UNION ALL SELECT target, digest, 'new' FROM new WHERE digest NOT IN (SELECT digest FROM first UNION ALL SELECT digest FROM second))"
)


@query(f"{_DUAL} SELECT * FROM m")
def j4_j14_dual_merge(s, d):
    new = table(s, d, "snapshots").groupBy("digest").agg(F.min("content").alias("content"))
    to = F.when(c("content").startswith('{"data":{'), "first").when(c("content").startswith('{"data":['), "second").otherwise("skip")
    return archive.dual_merge(copy(s, d, "first"), copy(s, d, "second"), new, to)


@query(f"{_DUAL} SELECT origin, target, count(*) AS n FROM m GROUP BY ALL")
def a17_dual_merge_stats(s, d):
    return j4_j14_dual_merge(s, d).groupBy("origin", "target").agg(F.count("*").alias("n"))


@query(f"WITH {q.CAP}, x AS (SELECT digest FROM snapshots UNION ALL SELECT actual_digest FROM download_results WHERE actual_digest IS NOT NULL) SELECT digest, ts, url, urlkey, capture_id FROM cap WHERE {q.is_digest('digest')} AND digest NOT IN (SELECT digest FROM x)")
def j5_u1_p10_missing_from(s, d):
    known = table(s, d, "snapshots").select("digest").unionByName(log(s, d).select(c("actual_digest").alias("digest"))).distinct()
    return cap(s, d).where(digest.is_digest(c("digest"))).join(known, "digest", "left_anti").select("digest", "ts", "url", "urlkey", "capture_id")


@query("SELECT s.snap_id, s.digest, s.content FROM snapshots s WHERE s.digest IN (SELECT expected_digest FROM download_results WHERE expected_digest IS NOT NULL)")
def j10_export(s, d):
    return table(s, d, "snapshots").join(table(s, d, "download_results").select(c("expected_digest").alias("digest")), "digest", "left_semi").select("snap_id", "digest", "content")


@query("SELECT count(*) AS requested, count(*) FILTER (digest IN (SELECT digest FROM snapshots)) AS found FROM (SELECT DISTINCT expected_digest AS digest FROM download_results WHERE expected_digest IS NOT NULL)")
def j10_export_summary(s, d):
    asked = table(s, d, "download_results").select(c("expected_digest").alias("digest")).where("digest is not null").distinct()
    there = table(s, d, "snapshots").select("digest").distinct().withColumn("there", F.lit(True))
    return asked.join(there, "digest", "left").agg(F.count("*").alias("requested"), F.count("there").alias("found"))


@query(f"WITH {q.CAP}, {q.EARLIEST} SELECT r.res_id, f.ts, f.url FROM resolutions r LEFT JOIN first_cap f USING (digest)")
def j13_multi_get(s, d):
    return table(s, d, "resolutions").select("res_id", "digest").join(archive.earliest_captures(cap(s, d)), "digest", "left").select("res_id", "ts", "url")


_RECONCILE = f"WITH {q.CAP}, {q.SNAP}, {q.EARLIEST} SELECT snap_id, CASE WHEN a.digest IS NULL AND b.digest IS NULL THEN 'not_in_index' WHEN a.digest IS NULL THEN 'by_expected_only' WHEN s.ts IS NULL THEN 'time_missing' WHEN s.ts <> a.ts THEN 'later_time' ELSE 'agrees' END AS report, coalesce(a.ts, b.ts, s.ts) AS ts FROM snap s LEFT JOIN first_cap a ON a.digest = s.digest LEFT JOIN first_cap b ON b.digest = s.expected_digest"


@query(_RECONCILE)
def j15_reconcile(s, d):
    first = archive.earliest_captures(cap(s, d))
    a, b = first.select("digest", c("ts").alias("ts_a")), first.select(c("digest").alias("expected_digest"), c("ts").alias("ts_b"))
    t = snap(s, d).join(a, "digest", "left").join(b, "expected_digest", "left")
    report = F.when(c("ts_a").isNull() & c("ts_b").isNull(), "not_in_index").when(c("ts_a").isNull(), "by_expected_only").when(c("ts").isNull(), "time_missing").when(c("ts") != c("ts_a"), "later_time").otherwise("agrees")
    return t.select("snap_id", report.alias("report"), F.coalesce("ts_a", "ts_b", "ts").alias("ts"))


@query(f"WITH {q.CAP} SELECT digest, arg_min(url, row(-epoch_us(seen_at), capture_id)) AS url, max(epoch_us(seen_at))::BIGINT AS seen FROM cap WHERE digest IS NOT NULL GROUP BY 1")
def j16_first_seen_row(s, d):
    order = F.struct((-F.unix_micros("seen_at")).alias("newest"), "capture_id")
    return cap(s, d).where("digest is not null").groupBy("digest").agg(F.min_by("url", order).alias("url"), F.max(F.unix_micros("seen_at")).alias("seen"))


@query("SELECT capture_id, CASE mimetype WHEN 'text/html' THEN 'pages' WHEN 'application/json' THEN 'data' ELSE 'none' END AS place FROM captures")
def j17_partition_lookup(s, d):
    places = s.createDataFrame([("text/html", "pages"), ("application/json", "data")], "mimetype string, place string")  # a fixed table of two rows
    return table(s, d, "captures").select("capture_id", "mimetype").join(F.broadcast(places), "mimetype", "left").select("capture_id", F.coalesce("place", F.lit("none")).alias("place"))


@query("SELECT count(DISTINCT r.digest) AS loaded, count(DISTINCT r.digest) FILTER (r.digest NOT IN (SELECT digest FROM snapshots)) AS new FROM resolutions r WHERE digest IS NOT NULL")
def u2_load_digests(s, d):
    asked = table(s, d, "resolutions").select("digest").where("digest is not null").distinct()
    known = table(s, d, "snapshots").select("digest").distinct().withColumn("there", F.lit(1))
    return asked.join(known, "digest", "left").agg(F.count("*").alias("loaded"), F.count_if(c("there").isNull()).alias("new"))


@query("WITH f AS (SELECT CAST(date_trunc('month', seen_at) AS DATE)::VARCHAR AS file, digest FROM captures), o AS (SELECT digest, max(file) AS file FROM f WHERE digest IS NOT NULL GROUP BY 1) SELECT f.file, CASE WHEN count(f.digest) = 0 THEN '0' WHEN f.file IN (SELECT file FROM o) THEN '+' ELSE '-' END AS mark FROM f GROUP BY f.file")
def u3_find_unused(s, d):
    month = F.date_format(F.date_trunc("month", "seen_at"), "yyyy-MM-dd")
    rows = cap(s, d).select(month.alias("file"), (-F.unix_seconds(F.date_trunc("month", "seen_at"))).alias("rank"), "digest")
    return archive.unused_files(rows, "file", "rank", "digest")


@query("SELECT DISTINCT d AS digest FROM (SELECT digest AS d FROM snapshots UNION ALL SELECT expected_digest FROM snapshots) WHERE d IS NOT NULL")
def u4_referenced_digests(s, d):
    both = F.array_compact(F.array("digest", "expected_digest"))
    return table(s, d, "snapshots").select(F.explode(both).alias("digest")).distinct()


_NAMES = "raw AS (SELECT doc_id, text, source, CASE doc_id % 10 WHEN 0 THEN upper(md5(text)) WHEN 1 THEN {x} ELSE {b} END AS name, {b} AS actual FROM documents WHERE text IS NOT NULL)".format(b=q.b32("text"), x=q.b32("(text || 'x')"))


def raw(s, d):
    """Documents as digest-named files, a tenth of them with a name that is no digest, a tenth with another's digest."""
    t = table(s, d, "documents").where("text is not null")
    actual = digest.sha1_base32(c("text"))
    return t.select("doc_id", "text", "source", F.when(c("doc_id") % 10 == 0, F.upper(F.md5("text"))).when(c("doc_id") % 10 == 1, digest.sha1_base32(F.concat("text", F.lit("x")))).otherwise(actual).alias("name"), actual.alias("actual"))


@query(f"WITH {_NAMES} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT {q.is_digest('name')} THEN 'not_a_digest' WHEN name IN (SELECT digest FROM snapshots) THEN 'already_present' WHEN name <> actual THEN 'digest_mismatch' ELSE 'success' END AS outcome FROM raw) GROUP BY 1")
def snk12_u5_store_save(s, d):
    known = table(s, d, "snapshots").select(c("digest").alias("name")).distinct().withColumn("there", F.lit(True))
    t = raw(s, d).join(known, "name", "left")
    outcome = F.when(~digest.is_digest(c("name")), "not_a_digest").when(c("there"), "already_present").when(c("name") != c("actual"), "digest_mismatch").otherwise("success")
    return t.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT r.result_id, s.content FROM (SELECT result_id, actual_digest FROM download_results) r LEFT JOIN (SELECT digest, min(content) AS content FROM snapshots GROUP BY 1) s ON s.digest = r.actual_digest")
def snk13_store_get(s, d):
    stored = table(s, d, "snapshots").groupBy(c("digest").alias("actual_digest")).agg(F.min("content").alias("content"))
    return table(s, d, "download_results").select("result_id", "actual_digest").join(stored, "actual_digest", "left").select("result_id", "content")


# Aggregates -------------------------------------------------------------------------------------------------------

_REASON = f"CASE WHEN NOT {q.is_digest('name')} THEN 'name_is_no_digest' WHEN name <> actual THEN 'digest_mismatch' WHEN regexp_matches(regexp_replace(text, '[\\r\\n \\t]+$', ''), '[\\r\\n]') THEN 'not_a_single_line' ELSE 'written' END"


@query(f"WITH {_NAMES} SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM raw) GROUP BY 1")
def a6_a8_l9_pack_summary(s, d):
    fault = snapshot.unprocessed(c("text"))["fault"]
    reason = F.when(~digest.is_digest(c("name")), "name_is_no_digest").when(c("name") != c("actual"), "digest_mismatch").when(fault.isNotNull(), "not_a_single_line").otherwise("written")
    return raw(s, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_PACKED = f"p AS (SELECT name AS digest, min(regexp_replace(text, '[\\r\\n \\t]+$', '')) AS content, min(regexp_extract(text, '([\\r\\n \\t]*)$', 1)) AS space FROM raw WHERE {_REASON} = 'written' GROUP BY 1)"


@query(f"WITH {_NAMES}, {q.LOG}, {_PACKED}, l AS (SELECT actual_digest AS digest, arg_max(expected_digest, row(observed, result_id)) AS e FROM log GROUP BY 1) SELECT p.digest, l.e AS expected_digest, sha1(content) AS content_sha1, CASE WHEN space <> chr(10) THEN hex(encode(space)) END AS space FROM p LEFT JOIN l USING (digest)")
def l1_a12_pack(s, d):
    u = raw(s, d).where(digest.is_digest(c("name")) & (c("name") == c("actual"))).select("name", snapshot.unprocessed(c("text")).alias("u")).where("u.fault is null")
    packed = u.groupBy(c("name").alias("digest")).agg(F.min("u.content").alias("content"), F.min("u.space").alias("space"))
    last = log(s, d).groupBy(c("actual_digest").alias("digest")).agg(F.max_by("expected_digest", F.struct("observed", "result_id")).alias("expected_digest"))
    return packed.join(last, "digest", "left").select("digest", "expected_digest", F.sha1("content").alias("content_sha1"), F.hex(F.nullif(c("space"), F.lit("\n"))).alias("space"))


@query(f"{_BASE}, t AS (SELECT DISTINCT s.digest, CASE WHEN min(s.content) LIKE '{{\"created_at\":%' THEN 'flat' WHEN min(s.content) LIKE '{{\"data\":%' THEN 'data' ELSE 'none' END AS place FROM snapshots s GROUP BY 1) SELECT place, count(*) AS files, count(r.digest) AS resolved FROM t LEFT JOIN resolved r USING (digest) GROUP BY 1")
def l2_l7_a7_compact_summary(s, d):
    t = table(s, d, "snapshots").groupBy("digest").agg(F.min("content").alias("content"))
    place = F.when(c("content").startswith('{"created_at":'), "flat").when(c("content").startswith('{"data":'), "data").otherwise("none")
    r = resolved(s, d).select("digest", F.lit(1).alias("there"))
    return t.select("digest", place.alias("place")).join(r, "digest", "left").groupBy("place").agg(F.count("*").alias("files"), F.count("there").alias("resolved"))


@query(f"WITH {_NAMES}, g AS (SELECT name, count(*) AS n FROM raw WHERE {q.is_digest('name')} GROUP BY 1) SELECT (SELECT count(*) FROM raw) AS files, (SELECT count(*) FROM raw WHERE NOT {q.is_digest('name')}) AS stray, count(*) AS digests, count(*) FILTER (n > 1) AS duplicates, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_files FROM g")
def a9_data_info(s, d):
    t = raw(s, d).groupBy("name").agg(F.count("*").alias("n"), F.first(digest.is_digest(c("name"))).alias("good"))
    dup = c("good") & (c("n") > 1)
    return t.agg(F.sum("n").alias("files"), F.sum(F.when(~c("good"), c("n")).otherwise(0)).alias("stray"), F.count_if("good").alias("digests"), F.count_if(dup).alias("duplicates"), F.sum(F.when(dup, c("n")).otherwise(0)).alias("duplicate_files"))


@query("SELECT regexp_extract(path, '([^/]+)\\.jsonl?$', 1) AS name, min(path) AS first_path, count(*) AS n FROM small_files GROUP BY 1")
def a10_first_path(s, d):
    return table(s, d, "small_files").groupBy(F.regexp_extract("path", r"([^/]+)\.jsonl?$", 1).alias("name")).agg(F.min("path").alias("first_path"), F.count("*").alias("n"))


@query(f"WITH {_NAMES} SELECT doc_id, name, actual FROM raw WHERE name IN (SELECT name FROM raw GROUP BY 1 HAVING count(*) > 1)")
def a11_verify_duplicates(s, d):
    t = raw(s, d)
    twice = t.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    return t.join(twice, "name", "left_semi").select("doc_id", "name", "actual")


@query(f"WITH {q.CAP}, r AS (SELECT DISTINCT d FROM (SELECT digest AS d FROM snapshots UNION ALL SELECT expected_digest FROM snapshots)), m AS (SELECT digest, min(row(ts, epoch_us(seen_at)::BIGINT, capture_id)) AS m FROM cap WHERE ts IS NOT NULL AND digest IN (SELECT d FROM r WHERE d IS NOT NULL) GROUP BY 1) SELECT digest, m[1] AS ts, m[3] AS capture_id FROM m")
def a13_earliest_referenced(s, d):
    wanted = u4_referenced_digests(s, d)
    rows = cap(s, d).where("ts is not null").join(wanted, "digest", "left_semi")
    return rows.groupBy("digest").agg(F.min(F.struct("ts", F.unix_micros("seen_at").alias("seen"), "capture_id")).alias("m")).select("digest", "m.ts", "m.capture_id")


@query(f"WITH {_NAMES} SELECT doc_id, name AS expected, actual AS found, count(*) OVER () AS mismatches FROM raw WHERE {q.is_digest('name')} AND name <> actual")
def a15_store_verify(s, d):
    bad = raw(s, d).where(digest.is_digest(c("name")) & (c("name") != c("actual")))
    n = bad.agg(F.count("*").alias("mismatches"))
    return bad.select("doc_id", c("name").alias("expected"), c("actual").alias("found")).join(F.broadcast(n))


@query(f"WITH {q.CAP} SELECT coalesce(CASE WHEN ts IS NULL THEN 'bad_time' WHEN coalesce(length <> '-' AND TRY_CAST(length AS BIGINT) IS NULL, false) THEN 'bad_length' END, 'inserted') AS outcome, count(*) AS n FROM cap GROUP BY 1")
def a18_l10_fill_counters(s, d):
    outcome = F.when(c("ts").isNull(), "bad_time").when(cdx.length_fault(c("length")), "bad_length").otherwise("inserted")
    return cap(s, d).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


# Ordering checks --------------------------------------------------------------------------------------------------

_KEYED = f"WITH {q.LINES}, k AS (SELECT *, CASE WHEN good THEN {q.order_key('digest')} END AS k FROM parsed)"


@query(f"{_KEYED}, b AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k WHERE line <> '') SELECT line_id, CASE WHEN k IS NULL THEN 'invalid' WHEN before IS NULL OR k > before THEN 'ok' WHEN k = before THEN 'duplicate' ELSE 'out_of_order' END AS status FROM b")
def g1_l4_check_order(s, d):
    t = lines(s, d).where("line <> ''").withColumn("digest", snapshot.parse(c("line"))["digest"])
    return archive.order_report(t, "file_name", "line_no", "digest").select("line_id", "status")


@query(
    f"{_KEYED}, v AS (SELECT *, contains(split_part(split_part(line, '\"content\":', 1), '\"format\":', 1), '\"url\":\"') AS has_url, CASE WHEN json_valid(content) THEN content::JSON END AS j, "
    f"CASE WHEN NOT good OR (timestamp <> '' AND NOT {q.real('timestamp')}) THEN 'invalid_line' ELSE {q.verify('digest', 'content', 'format', 'chr(10)')} END AS state FROM k WHERE line <> ''), "
    "r AS (SELECT *, state NOT IN ('invalid_line', 'closing_whitespace') AS read, CASE WHEN state NOT IN ('invalid_line', 'closing_whitespace') THEN k END AS own, "
    "CASE WHEN json_type(j, '$.data') IS NOT NULL THEN CASE WHEN json_type(j, '$.data.id') = 'VARCHAR' AND json_type(j, '$.data.author_id') = 'VARCHAR' THEN 'https://twitter.com/' || "
    "(list_filter(from_json(j->'$.includes.users', '[{\"id\":\"VARCHAR\",\"username\":\"VARCHAR\"}]'), lambda x: x.id = (j->>'$.data.author_id'))[1]).username || '/status/' || (j->>'$.data.id') END "
    "WHEN json_type(j, '$.user.screen_name') = 'VARCHAR' AND json_type(j, '$.id_str') = 'VARCHAR' THEN 'https://twitter.com/' || (j->>'$.user.screen_name') || '/status/' || (j->>'$.id_str') END AS inferred FROM v), "
    "b AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) "
    "SELECT line_id, state, CASE WHEN own IS NULL THEN 'invalid' WHEN before IS NULL OR own > before THEN 'ok' WHEN own = before THEN 'duplicate' ELSE 'out_of_order' END AS status, read AND timestamp = '' AS missing_timestamp, read AND timestamp = '' AND has_url AS url_without_timestamp, "
    "read AND expected_digest = digest AS redundant_expected_digest, coalesce(read AND has_url AND inferred = url, false) AS redundant_url FROM b"
)
def g1_l4_check_report(s, d):
    return archive.check_report(lines(s, d), "file_name", "line_no").drop("file_name", "line_no", "line")


_ACCEPTED = f"{_KEYED}, v AS (SELECT *, CASE WHEN good THEN {q.verify('digest', 'content', 'format', 'chr(10)')} END AS state FROM k), b AS (SELECT *, max(CASE WHEN state = 'ok' THEN k END) OVER (PARTITION BY file_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)"


def _accepted(s, d):
    t = archive.snapshot_state(lines(s, d), "\n").select("*", c("parsed.digest").alias("digest"))
    state = F.when(c("parsed").isNull(), "invalid_line").otherwise(snapshot.verify(c("parsed.digest"), c("parsed.content"), c("parsed.format"), "\n"))
    return archive.accepted_order_report(t.withColumn("state", state), "file_name", "line_no", "digest", c("state") == "ok")


@query(f"{_ACCEPTED} SELECT line_id, coalesce(state, 'invalid_line') AS state, CASE WHEN coalesce(state, '') <> 'ok' THEN 'invalid' WHEN before IS NULL OR k > before THEN 'ok' WHEN k = before THEN 'duplicate' ELSE 'out_of_order' END AS status FROM b")
def g2_g3_validate_lines(s, d):
    return _accepted(s, d).select("line_id", "state", "status")


@query(f"{_ACCEPTED}, r AS (SELECT file_name, CASE WHEN coalesce(state, '') <> 'ok' THEN 'invalid' WHEN before IS NULL OR k > before THEN 'ok' WHEN k = before THEN 'duplicate' ELSE 'out_of_order' END AS status, line_no FROM b) SELECT file_name, count(*) FILTER (status = 'ok') AS accepted, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status IN ('duplicate', 'out_of_order')) AS misplaced, min(line_no) FILTER (status <> 'ok') AS first_problem FROM r GROUP BY 1")
def g4_g5_file_report(s, d):
    t = _accepted(s, d)
    return t.groupBy("file_name").agg(F.count_if(c("status") == "ok").alias("accepted"), F.count_if(c("status") == "invalid").alias("invalid"), F.count_if(c("status").isin("duplicate", "out_of_order")).alias("misplaced"), F.min(F.when(c("status") != "ok", c("line_no"))).alias("first_problem"))


@query(f"{_KEYED}, b AS (SELECT *, lag(digest) OVER (PARTITION BY file_name ORDER BY line_no) AS before FROM k WHERE good) SELECT line_id, digest FROM b WHERE before IS NULL OR before <> digest")
def snk1_g6_written_lines(s, d):
    t = lines(s, d).withColumn("digest", snapshot.parse(c("line"))["digest"]).where("digest is not null")
    return archive.order_report(t, "file_name", "line_no", "digest").where("status <> 'duplicate'").select("line_id", "digest")


@query("SELECT digest, min(snap_id) AS snap_id FROM snapshots GROUP BY 1")
def g9_first_occurrence(s, d):
    return table(s, d, "snapshots").groupBy("digest").agg(F.min("snap_id").alias("snap_id"))


@query("SELECT urlkey, timestamp, capture_id FROM captures ORDER BY urlkey, timestamp, capture_id LIMIT 100")
def g8_g10_first_items(s, d):
    return table(s, d, "captures").select("urlkey", "timestamp", "capture_id").orderBy("urlkey", "timestamp", "capture_id").limit(100)


# State and upserts ------------------------------------------------------------------------------------------------


@query("SELECT urlkey, timestamp, arg_max(coalesce(digest, ''), row(seen_at, capture_id)) AS digest, arg_max(capture_id, row(seen_at, capture_id)) AS capture_id FROM captures GROUP BY 1, 2")
def k1_index_upsert(s, d):
    rows = cap(s, d).select("urlkey", c("stamp").alias("timestamp"), F.coalesce("digest", F.lit("")).alias("digest"), "seen_at", "capture_id")
    rows = rows.withColumn("id", c("capture_id"))
    return archive.upsert(rows, ["urlkey", "timestamp"], [c("seen_at"), c("id")]).select("urlkey", "timestamp", "digest", "capture_id")


@query("SELECT capture_id, CASE WHEN statuscode = '200' THEN 'done' WHEN epoch(seen_at) + 86400 > 1600000000 THEN 'in_progress' ELSE 'available' END AS status FROM captures")
def k2_k3_lease_status(s, d):
    status = archive.lease_status(c("statuscode") == "200", F.unix_seconds("seen_at") + 86400, F.lit(1_600_000_000))
    return cap(s, d).select("capture_id", status.alias("status"))


_LOG_KEY = ["url", "archive_ts", "expected_digest", "actual_digest"]


@query(f"WITH {q.LOG} SELECT url, archive_ts, expected_digest, actual_digest, min(observed) AS observed, arg_min(result_id, row(observed, result_id)) AS result_id FROM log GROUP BY 1, 2, 3, 4")
def k4_log_insert(s, d):
    rows = log(s, d).withColumn("o", F.struct("observed", "result_id"))
    return archive.log_insert(rows.drop("observed"), _LOG_KEY, "o").select(*_LOG_KEY, c("o.observed").alias("observed"), "result_id")


@query("WITH w AS (SELECT DISTINCT url, epoch(received_at)::BIGINT AS observed FROM download_results WHERE outcome = 'not_found') SELECT * FROM w")
def k5_withheld_insert(s, d):
    return table(s, d, "download_results").where("outcome = 'not_found'").select("url", times.to_unix(c("received_at").cast("timestamp")).alias("observed")).distinct()


@query(f"WITH {q.LOG} SELECT url, archive_ts, expected_digest, actual_digest, min(observed) AS observed FROM log GROUP BY 1, 2, 3, 4")
def k6_k8_log_merge(s, d):
    t = log(s, d)
    return archive.log_merge(t.where("result_id % 2 = 0"), t.where("result_id % 2 = 1"), t, key=_LOG_KEY, observed="observed")


@query(f"WITH {q.LOG}, a AS (SELECT url, actual_digest, min(observed) AS observed FROM log WHERE result_id % 3 = 0 GROUP BY 1, 2), b AS (SELECT url, actual_digest, min(observed) AS observed FROM log WHERE result_id % 3 <> 0 GROUP BY 1, 2) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.url = b.url AND a.actual_digest = b.actual_digest)")
def k7_log_import(s, d):
    key, t = ["url", "actual_digest"], log(s, d)
    return archive.log_import(archive.log_merge(t.where("result_id % 3 = 0"), key=key, observed="observed"), t.where("result_id % 3 <> 0"), key, "observed")


# Pipelines --------------------------------------------------------------------------------------------------------


@query(f"WITH {q.SNAP} SELECT digest, url, count(*) AS n FROM (SELECT s.digest, u.url FROM snap s JOIN ({archive_queries.SQL['e8_infer_url']}) u USING (snap_id) WHERE s.url IS NULL AND s.ts IS NULL AND s.expected_digest IS NULL) GROUP BY 1, 2")
def urls_to_fill(s, d):
    return pipelines.urls_to_fill(snap(s, d)).groupBy("digest", "url").agg(F.count("*").alias("n"))


@query(f"WITH {_NAMES} SELECT count(*) AS total, count(*) FILTER ({q.is_digest('name')}) AS valid, count(*) FILTER ({q.is_digest('name')} AND name IN (SELECT {q.b32('text')} FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)) AS known FROM raw")
def clean_flat(s, d):
    known = table(s, d, "documents").where("doc_id % 2 = 0 and text is not null").select(digest.sha1_base32(c("text")).alias("digest"))
    return pipelines.clean_report(raw(s, d), known)


@query(f"WITH {q.SNAP} SELECT snap_id, '{{\"digest\":\"' || digest || '\",' || coalesce('\"timestamp\":\"' || ts || '\",', '') || '\"format\":{{\"type\":\"gzip\",\"closing_whitespace\":\"\\t\"}},\"content\":' || content || '}}' AS line FROM snap WHERE json_valid(content)")
def e12_migrate(s, d):
    # the old line has its fields in another order, the format as a text and the white space beside it
    stamp = F.coalesce(F.concat(F.lit('"timestamp": "'), "ts", F.lit('", ')), F.lit(""))
    old = F.concat(F.lit('{"closing_whitespace":"\\t", '), stamp, F.lit('"content": '), "content", F.lit(' ,"digest": "'), "digest", F.lit('","format":"gzip"}'))
    return snap(s, d).select("snap_id", pipelines.migrated(old).alias("line")).where("line is not null")


@query(
    f"{_KEYED}, v AS (SELECT *, CASE WHEN NOT good OR (timestamp <> '' AND NOT {q.real('timestamp')}) THEN 'invalid_line' ELSE {q.verify('digest', 'content', 'format', 'chr(10)')} END AS state, last_value(k IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k) "
    "SELECT file_name, count(*) FILTER (state = 'ok') AS valid, count(*) FILTER (state NOT IN ('ok', 'unsupported_format')) AS invalid, count(*) FILTER (state = 'unsupported_format') AS skipped, count(*) FILTER (k <= before) AS misplaced, count(*) AS lines FROM v GROUP BY 1"
)
def g12_plain_report(s, d):
    return pipelines.plain_report(lines(s, d), "file_name", "line_no")


@query(f"WITH t AS (SELECT text, regexp_replace(text, '[\\r\\n \\t]+$', '') AS content, regexp_extract(text, '([\\r\\n \\t]*)$', 1) AS space FROM documents WHERE text IS NOT NULL) SELECT {q.b32('text')} AS digest, CASE WHEN regexp_matches(content, '[\\r\\n]') THEN 'internal_line_break' END AS fault, count(*) AS n FROM t GROUP BY 1, 2")
def snk2_raw_to_snapshots(s, d):
    t = table(s, d, "documents").where("text is not null").select("text")
    return pipelines.snapshot_lines(t).groupBy("digest", "fault").agg(F.count("*").alias("n"))


@query(f"WITH {_NAMES} SELECT bool_and(name = actual) AS ok, count(*) AS checked, count(*) FILTER (name <> actual) AS mismatches FROM raw WHERE {q.is_digest('name')}")
def a16_verify_all(s, d):
    t = raw(s, d).where(digest.is_digest(c("name"))).withColumn("ok", c("name") == c("actual"))
    return pipelines.verify_all(t)


@query("SELECT capture_id, original AS url, timestamp AS ts, coalesce(digest, '-') AS digest, coalesce(nullif(mimetype, '-'), '-') AS mime_type, statuscode AS status FROM captures")
def snk15_record_rows(s, d):
    dash = lambda x: F.coalesce(x, F.lit("-"))
    return table(s, d, "captures").select("capture_id", c("original").alias("url"), c("timestamp").alias("ts"), dash(c("digest")).alias("digest"), dash(c("mimetype")).alias("mime_type"), dash(c("statuscode")).alias("status"))


@query("SELECT outcome, CASE WHEN outcome = 'success' AND actual_digest IS NOT NULL THEN 'logged_mismatch' WHEN outcome = 'success' THEN 'kept' WHEN outcome = 'not_found' THEN 'ignored' ELSE 'failed' END AS act, count(*) AS n FROM download_results GROUP BY ALL")
def l15_download_outcomes(s, d):
    act = F.when((c("outcome") == "success") & c("actual_digest").isNotNull(), "logged_mismatch").when(c("outcome") == "success", "kept").when(c("outcome") == "not_found", "ignored").otherwise("failed")
    return table(s, d, "download_results").groupBy("outcome", act.alias("act")).agg(F.count("*").alias("n"))
