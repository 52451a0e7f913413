"""Joins, aggregates and checks on captures, snapshots and logs: resolution, merging, ordering, index and log state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import digest, snapshot, times



def distinct_captures(captures: DataFrame) -> DataFrame:
    """The distinct (digest, ts, url) of captures. Rows without a digest or time are left out."""
    return captures.where("digest is not null and ts is not null").select("digest", "ts", "url").distinct()


def captures_by_digest(captures: DataFrame, most: int = 10_000) -> DataFrame:
    """(digest, n, captures): how many distinct (ts, url) each digest has, and these in order.

    A digest of more than most (an empty body may have a third of a crawl) has null captures: its rows are those of
    distinct_captures, as a cell doesn't hold them.
    """
    rows = distinct_captures(captures)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("n"))
    lists = rows.join(sizes.where(F.col("n") <= most), "digest", "left_semi").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("ts", "url"))).alias("captures"))
    return sizes.join(lists, "digest", "left")


def earliest_captures(captures: DataFrame) -> DataFrame:
    """(digest, ts, url, others): the earliest capture of each digest and how many distinct ones there are besides.

    Two partial aggregations; no digest's captures are gathered in one place.
    """
    best = distinct_captures(captures).groupBy("digest").agg(F.min(F.struct("ts", "url")).alias("first"), (F.count("*") - 1).alias("others"))
    return best.select("digest", "first.ts", "first.url", "others")


def resolve(targets: DataFrame, captures: DataFrame, log: DataFrame) -> DataFrame:
    """(digest, ts, url, expected_digest, others) for each target digest that has a capture.

    A capture under the digest itself wins; else one under a digest that the log says was declared for it: the declared
    digest with the earliest capture, the lesser (valid before invalid, by bytes) where equal. others counts the
    captures left over, of the digest itself or of its declared digests.
    """
    wanted = targets.select("digest").distinct()
    own = earliest_captures(captures.join(wanted, "digest", "left_semi"))
    left = wanted.join(own, "digest", "left_anti")
    declared = log.select(F.col("actual_digest").alias("digest"), "expected_digest").distinct().join(left, "digest", "left_semi")
    asked = captures.join(declared.select(F.col("expected_digest").alias("digest")).distinct(), "digest", "left_semi")
    via = declared.join(earliest_captures(asked).withColumnRenamed("digest", "expected_digest"), "expected_digest")
    order = F.struct("ts", "url", digest.order_key(F.col("expected_digest")).isNull().alias("invalid"), F.coalesce(digest.order_key(F.col("expected_digest")), F.col("expected_digest")).alias("key"), "expected_digest")
    chosen = via.groupBy("digest").agg(F.min(order).alias("c"), (F.sum(F.col("others") + 1) - 1).alias("others"))
    own = own.select("digest", "ts", "url", F.lit(None).cast("string").alias("expected_digest"), "others")
    return own.unionByName(chosen.select("digest", "c.ts", "c.url", "c.expected_digest", "others"))


def missing(targets: DataFrame, captures: DataFrame, log: DataFrame) -> DataFrame:
    """The target digests that resolve() finds nothing for. Only digests are joined, no capture is chosen."""
    held = captures.where("digest is not null and ts is not null").select("digest").distinct()
    left = targets.select("digest").distinct().join(held, "digest", "left_anti")
    declared = log.select(F.col("actual_digest").alias("digest"), "expected_digest").distinct().join(left, "digest", "left_semi")
    found = declared.join(held.withColumnRenamed("digest", "expected_digest"), "expected_digest", "left_semi").select("digest").distinct()
    return left.join(found, "digest", "left_anti")


def unused_captures(targets: DataFrame, captures: DataFrame, log: DataFrame) -> DataFrame:
    """(digest, expected_digest, ts, url) of the captures that resolve() could have chosen and didn't, one row each.

    expected_digest is null for captures under the target itself. As many rows as the others of resolve() add up to.
    """
    chosen = resolve(targets, captures, log).select("digest", F.col("ts").alias("ts_0"), F.col("url").alias("url_0"), F.col("expected_digest").alias("declared_0"))
    declared = log.select(F.col("actual_digest").alias("digest"), "expected_digest").distinct().join(chosen.where("declared_0 is not null"), "digest").select("digest", "expected_digest", F.col("expected_digest").alias("under"))
    under = declared.unionByName(chosen.where("declared_0 is null").select("digest", F.lit(None).cast("string").alias("expected_digest"), F.col("digest").alias("under")))
    could = under.join(distinct_captures(captures).withColumnRenamed("digest", "under"), "under").select("digest", "expected_digest", "ts", "url")
    same = F.col("expected_digest").eqNullSafe(F.col("declared_0")) & (F.col("ts") == F.col("ts_0")) & F.col("url").eqNullSafe(F.col("url_0"))
    return could.join(chosen, "digest").where(~same).select("digest", "expected_digest", "ts", "url")


def enhance(snapshots: DataFrame, captures: DataFrame, log: DataFrame) -> DataFrame:
    """Snapshots (snap_id, digest, expected_digest, ts, url) with the earliest capture filled in where the time is missing.

    Looked up by content digest, then by the expected digest (the snapshot's own valid one, else the log's last). Columns:
    the snapshot's, with ts, url, expected_digest replaced and outcome already, enhanced or unmatched. An expected
    digest is dropped where the content digest itself was found.
    """
    first = earliest_captures(captures)
    last = log.where(digest.is_digest(F.col("expected_digest"))).groupBy(F.col("actual_digest").alias("digest")).agg(F.max_by("expected_digest", F.struct("observed", "expected_digest")).alias("logged"))
    open_ = snapshots.where("ts is null").select("snap_id", "digest", "expected_digest", "url")
    a = open_.join(first.select("digest", F.col("ts").alias("ts1"), F.col("url").alias("url1")), "digest", "left").join(last, "digest", "left")
    own = F.when(digest.is_digest(F.col("expected_digest")), F.col("expected_digest"))
    b = a.withColumn("by", F.coalesce(own, "logged")).join(first.select(F.col("digest").alias("by"), F.col("ts").alias("ts2"), F.col("url").alias("url2")), "by", "left")
    found = F.col("ts1").isNotNull()
    done = b.select("snap_id", "digest", F.when(~found & F.col("ts2").isNotNull(), F.col("by")).when(~found, F.col("expected_digest")).alias("expected_digest"), F.coalesce("ts1", "ts2").alias("ts"), F.coalesce("url1", "url2", "url").alias("url"), F.when(F.coalesce("ts1", "ts2").isNull(), "unmatched").otherwise("enhanced").alias("outcome"))
    passed = snapshots.where("ts is not null").select("snap_id", "digest", "expected_digest", "ts", "url", F.lit("already").alias("outcome"))
    return passed.unionByName(done)


def merge_pair(first: DataFrame, second: DataFrame) -> DataFrame:
    """(digest, source, line) of two files (digest, line) with one line per digest: first, second, match or collision.

    Of colliding lines the first's is kept only if it has fewer bytes.
    """
    both = first.select("digest", F.col("line").alias("a")).join(second.select("digest", F.col("line").alias("b")), "digest", "full_outer")
    source = F.when(F.col("b").isNull(), "first").when(F.col("a").isNull(), "second").when(F.col("a") == F.col("b"), "match").otherwise("collision")
    kept = F.when(F.col("b").isNull() | (F.octet_length("a") < F.octet_length("b")), F.col("a")).otherwise(F.col("b"))
    return both.select("digest", source.alias("source"), kept.alias("line"))


def one_per_digest(lines: DataFrame, number: str) -> DataFrame:
    """The first line of each digest."""
    return lines.groupBy("digest").agg(F.min_by("line", number).alias("line"))


def dual_merge(first: DataFrame, second: DataFrame, new: DataFrame, classify: Column) -> DataFrame:
    """(target, digest, origin): existing lines stay; new ones whose digest neither file has go where classify sends them.

    classify gives first, second or skip from the columns of new; a skipped entry has target skip.
    """
    old = first.select(F.lit("first").alias("target"), "digest", F.lit("existing").alias("origin")).unionByName(second.select(F.lit("second").alias("target"), "digest", F.lit("existing").alias("origin")))
    fresh = new.join(first.select("digest").unionByName(second.select("digest")).distinct(), "digest", "left_anti")
    return old.unionByName(fresh.select(classify.alias("target"), "digest", F.lit("new").alias("origin")))


BLOCK = 100_000


def _running(lines: DataFrame, file: str, number: str, value: Column, last: bool) -> DataFrame:
    """lines with before: the last (or greatest) value that isn't null of all lines before each in its file.

    Files are cut into blocks of line numbers. The windows run over a block at a time, what earlier blocks hand on is one
    value per block; so a file of any length is spread over many tasks. number must be set and unique in a file.
    """
    of = (lambda c: F.last(c, ignorenulls=True)) if last else F.max
    rows = lines.withColumn("_value", value).withColumn("_block", F.floor(F.col(number) / BLOCK))
    ends = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(number))) if last else F.max("_value")
    blocks = rows.groupBy(F.col(file).alias("_file"), "_block").agg(ends.alias("_end"))
    handed = blocks.select("_file", F.col("_block").alias("_at"), of(F.col("_end")).over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_handed"))
    inner = rows.withColumn("_before", of(F.col("_value")).over(W.partitionBy(file, "_block").orderBy(number).rowsBetween(W.unboundedPreceding, -1)))
    joined = inner.join(handed, inner[file].eqNullSafe(F.col("_file")) & inner["_block"].eqNullSafe(F.col("_at")), "left")
    before = F.coalesce("_before", "_handed") if last else F.greatest("_before", "_handed")
    return joined.select(*[inner[c] for c in lines.columns], "_value", before.alias("before"))


def _ordered(rows: DataFrame) -> DataFrame:
    key, before = F.col("_value"), F.col("before")
    status = F.when(key.isNull(), "invalid").when(before.isNull() | (key > before), "ok").when(key == before, "duplicate").otherwise("out_of_order")
    return rows.withColumn("status", status).drop("_value")


def order_report(lines: DataFrame, file: str, number: str, name: str) -> DataFrame:
    """Each line with before (order key of the last digest before it) and status: ok, duplicate, out_of_order or invalid.

    The cursor moves on with every valid digest, as in a plain check of a file.
    """
    return _ordered(_running(lines, file, number, digest.order_key(F.col(name)), last=True))


LINE_START = r'\A\{"digest":"([A-Z2-7]{32})'


def merge_errors(first: DataFrame, second: DataFrame) -> DataFrame:
    """(side, line_number, reason, digest, line) of each line that may not stand in a merge input (line_number, line).

    A line must start with its digest (else invalid_line, shown with the line); the digest must be greater than that of
    the last such line before it (else duplicate or out_of_order). Nothing is left out; a strict merge of a side ends
    at its least line number here, and none is to be published.
    """
    sides = [df.select(F.lit(side).alias("side"), "line_number", "line", F.nullif(F.regexp_extract("line", LINE_START, 1), F.lit("")).alias("digest")) for df, side in ((first, "first"), (second, "second"))]
    t = order_report(sides[0].unionByName(sides[1]), "side", "line_number", "digest").where("status <> 'ok'")
    invalid = F.col("status") == "invalid"
    return t.select("side", "line_number", F.when(invalid, "invalid_line").otherwise(F.col("status")).alias("reason"), "digest", F.when(invalid, F.col("line")).alias("line"))


def accepted_order_report(lines: DataFrame, file: str, number: str, name: str, verified: Column) -> DataFrame:
    """As order_report, but the cursor moves on with accepted lines only: it is the greatest verified digest so far."""
    return _ordered(_running(lines, file, number, F.when(verified, digest.order_key(F.col(name))), last=False))


def upsert(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the given order, as one aggregate (no window, no sort of a key's rows)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def lease_status(done: Column, timeout: Column, now: Column) -> Column:
    """available, in_progress or done; a claim that has run out, like none, is available."""
    return F.when(F.coalesce(done, F.lit(False)), "done").when(timeout > now, "in_progress").otherwise("available")


def log_insert(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key and c != order]
    return rows.groupBy(*key).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest])


def log_merge(*logs: DataFrame, key: list[str], observed: str) -> DataFrame:
    """All entries of the logs, each key once with its least observation."""
    union = logs[0].select(*key, observed)
    for other in logs[1:]:
        union = union.unionByName(other.select(*key, observed))
    return union.groupBy(*key).agg(F.min(observed).alias(observed))


def log_import(existing: DataFrame, imported: DataFrame, key: list[str], observed: str) -> DataFrame:
    """existing, and of imported the keys it doesn't have, each once."""
    fresh = log_merge(imported, key=key, observed=observed).join(existing.select(*key), key, "left_anti")
    return existing.select(*key, observed).unionByName(fresh.select(*key, observed))


def unused_files(rows: DataFrame, file: str, rank: str, name: str) -> DataFrame:
    """(file, mark): 0 for a file without digests, - if newer files have all of its digests, + if it is needed.

    rank orders the files, the newest first.
    """
    owner = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(rank).alias(rank)).select(rank).distinct().withColumn("owns", F.lit(True))
    files = rows.groupBy(file, rank).agg(F.count(name).alias("n"))
    return files.join(owner, rank, "left").select(file, F.when(F.col("n") == 0, "0").when(F.col("owns"), "+").otherwise("-").alias("mark"))


def snapshot_state(lines: DataFrame, default: str) -> DataFrame:
    """Lines with their parsed fields (parsed) and state: invalid_line or what verification says."""
    parsed = lines.withColumn("parsed", snapshot.parse(F.col("line")))
    told = snapshot.verify(F.col("parsed.digest"), F.col("parsed.content"), F.col("parsed.format"), default)
    return parsed.withColumn("state", F.when(F.col("parsed").isNull() | (F.col("parsed.timestamp").isNotNull() & ~times.is_real(F.col("parsed.timestamp"))), "invalid_line").otherwise(told))


def check_report(lines: DataFrame, file: str, number: str, default: str = "\n") -> DataFrame:
    """Each line (file, number, line) that isn't empty with all that a check says of it.

    state and status as in snapshot_state and order_report; missing_timestamp, url_without_timestamp,
    redundant_expected_digest (it is the digest itself) and redundant_url (it would be inferred from the content), beside
    whatever the state is. Of a line that can't be read (invalid_line, closing_whitespace) nothing else is told, and it
    doesn't move the order's cursor.
    """
    t = snapshot_state(lines.where("line <> ''"), default)
    p = {x: F.when(~F.col("state").isin("invalid_line", "closing_whitespace"), F.col(f"parsed.{x}")) for x in snapshot.PARTS}
    read, no_time = p["digest"].isNotNull(), p["timestamp"].isNull()
    found = {
        "missing_timestamp": read & no_time,
        "url_without_timestamp": read & no_time & p["url"].isNotNull(),
        "redundant_expected_digest": F.coalesce(p["expected_digest"] == p["digest"], F.lit(False)),
        "redundant_url": F.coalesce(F.when(p["url"].isNotNull(), snapshot.inferred_url(p["content"]) == p["url"]), F.lit(False)),
    }
    told = t.select(*lines.columns, "state", p["digest"].alias("digest"), *[v.alias(k) for k, v in found.items()])
    return order_report(told, file, number, "digest").drop("digest", "before")
