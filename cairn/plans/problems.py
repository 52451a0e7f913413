"""The pN_ queries of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import digest
from cairn.operators import compaction, differences, nested, quarantine
from cairn.plans import sqltext as q
from cairn.session import shared_folder, table

_POST = ("/data", "/data/*")


def _below(parents: tuple[str, ...], *steps: str) -> tuple[str, ...]:
    """The paths below each parent, with and without the array around the last step."""
    base = [p + "/" + "/".join(steps) for p in parents]
    return (*base, *[b + "/*" for b in base])


#: The tables of an archived API answer.
ANSWER = {
    "post": nested.Table(_POST, ("id", "author_id", "created_at", "lang")),
    "text": nested.Table(tuple(p + "/text" for p in _POST), (), "post"),
    "edit": nested.Table(_below(_POST, "edit_history_tweet_ids"), (), "post"),
    "ref": nested.Table(_below(_POST, "referenced_tweets"), ("id", "type"), "post"),
    "url": nested.Table(_below(_POST, "entities", "urls"), ("url", "expanded_url", "start"), "post"),
    "image": nested.Table(_below(_below(_POST, "entities", "urls"), "images"), ("url", "width", "height"), "url"),
    "error": nested.Table(_below(("",), "errors"), ("detail", "value", "title", "type")),
    "user": nested.Table(_below(("",), "includes", "users"), ("id", "username")),
    "media": nested.Table(_below(("",), "includes", "media"), ("media_key", "type")),
    "variant": nested.Table(_below(_below(("",), "includes", "media"), "variants"), ("url", "bit_rate", "content_type"), "media"),
}
CHILD_KEY = {"post": "id", "text": None, "edit": None, "ref": "id", "url": "url", "image": "url", "error": "detail", "user": "id", "media": "media_key", "variant": "url"}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = nested.dewey_nodes(table(spark, folder, "snapshots"), "snap_id", "content", nested.paths_of(ANSWER))
    rows = nested.kinds_of_records(nodes, "snap_id", ANSWER, CHILD_KEY)
    place = lambda i: F.coalesce(F.get("places", F.lit(i)), F.lit(-1))
    return rows.select("snap_id", "rel", place(2).alias("grand_pos"), place(1).alias("parent_pos"), place(0).alias("pos"), "child_key")


FIELDS = ("expected_digest", "timestamp", "url", "format", "content")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    first, second = table(spark, folder, "merge_first"), table(spark, folder, "merge_second")
    copies = differences.copies_of_lines(first, second, digest.clean(F.col("digest")), {"first": "first_value", "second": "second_value"}, FIELDS)
    return differences.found_differences(differences.compare_copies(*copies, "digest", FIELDS), "digest")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.compact(table(spark, folder, "small_files"), shared_folder(spark, "compact")).select("file_id", "line_no")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    bad = quarantine.split(quarantine.load_lines(table(spark, folder, "raw_lines"), "line_id"))[1]
    return bad.select("line_id", F.get("errors", F.lit(0)).alias("reason"))


def _p1_sql() -> str:
    items = lambda v: f"CASE WHEN {v} IS NULL OR json_type({v}) = 'NULL' THEN [] WHEN json_type({v}) = 'ARRAY' THEN from_json({v}, '[\"JSON\"]') ELSE [{v}] END"

    def level(name: str, of: str, value: str, above: str) -> str:
        """name: the items of a value of each row of another level, with their places and those above."""
        return f"{name} AS (SELECT snap_id, i::INT AS pos, {above}, v FROM (SELECT snap_id, p, g, unnest(range(len(l))) AS i, unnest(l) AS v FROM (SELECT snap_id, pos AS p, parent_pos AS g, {items(value)} AS l FROM {of})) WHERE v IS NOT NULL AND json_type(v) <> 'NULL')"

    top, below, deep = "-1 AS parent_pos, -1 AS grand_pos", "p AS parent_pos, -1 AS grand_pos", "p AS parent_pos, g AS grand_pos"
    levels = [
        level("post", "j", "json_extract(v, '$.data')", top), level("edit", "post", "json_extract(v, '$.edit_history_tweet_ids')", below), level("ref", "post", "json_extract(v, '$.referenced_tweets')", below), level("url", "post", "json_extract(v, '$.entities.urls')", below),
        level("image", "url", "json_extract(v, '$.images')", deep), level("error", "j", "json_extract(v, '$.errors')", top), level("user", "j", "json_extract(v, '$.includes.users')", top), level("media", "j", "json_extract(v, '$.includes.media')", top), level("variant", "media", "json_extract(v, '$.variants')", below),
    ]
    rows = [f"SELECT snap_id, '{n}' AS rel, grand_pos, parent_pos, pos, coalesce(json_extract_string(v, '${'.' + k if k else ''}'), '') AS child_key FROM {n}" for n, k in CHILD_KEY.items() if n != "text"]
    rows.append("SELECT snap_id, 'text', -1, pos, 0, json_extract_string(v, '$.text') FROM post WHERE json_extract_string(v, '$.text') IS NOT NULL")
    return (
        "WITH c AS (SELECT snap_id, CASE WHEN json_valid(content) THEN content::JSON END AS v FROM snapshots), j AS (SELECT snap_id, -1 AS pos, -1 AS parent_pos, CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(v, '$')) THEN json_extract_string(v, '$')::JSON END ELSE v END AS v FROM c), "
        + ", ".join(levels) + " " + " UNION ALL ".join(rows)
    )


def _p2_sql() -> str:
    def side(name: str) -> str:
        values = ", ".join(q.canonical_json(f"json_extract(j, '$.{f}')", False) + f" AS {f}" for f in FIELDS)
        return f"{name} AS (SELECT DISTINCT d, {values} FROM (SELECT {q.clean('digest')} AS d, {name}_value::JSON AS j FROM merge_{name}))"

    values = lambda side, f: f"(SELECT d, list(DISTINCT coalesce({f}, '') ORDER BY coalesce({f}, '')) AS {side}_values FROM {side} GROUP BY 1)"
    differ = "".join(f" UNION ALL SELECT d, 'both', '{f}' FROM {values('first', f)} JOIN {values('second', f)} USING (d) WHERE first_values <> second_values" for f in FIELDS)
    keys = "k AS (SELECT d, max(a) AS a, max(b) AS b FROM (SELECT d, 1 AS a, 0 AS b FROM first UNION ALL SELECT d, 0, 1 FROM second) GROUP BY 1)"
    return f"WITH {side('first')}, {side('second')}, {keys} SELECT d AS digest, CASE WHEN b = 0 THEN 'first' ELSE 'second' END AS side, '' AS field FROM k WHERE a + b = 1{differ}"


def _p4_sql() -> str:
    lines = "l AS (SELECT file_id, i AS line_no, regexp_replace(x[i], '\\r$', '') AS line FROM (SELECT file_id, string_split(body, chr(10)) AS x FROM small_files) t, unnest(range(1, len(x) + 1)) u(i))"
    whole = "w AS (SELECT file_id, line_no, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM l WHERE line LIKE '%{%')"
    records = f"r AS (SELECT file_id, line_no, {q.clean("(j->>'$.digest')")} AS digest, {q.canonical_json("json_extract(j, '$.content')", True)} AS content FROM w WHERE json_type(j) = 'OBJECT' AND json_exists(j, '$.digest') AND json_exists(j, '$.content'))"
    return f"WITH {lines}, {whole}, {records} SELECT file_id, line_no::INT AS line_no FROM (SELECT *, row_number() OVER (PARTITION BY digest, content ORDER BY file_id, line_no) AS n FROM r) WHERE n = 1"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _p1_sql(), "p2_found": _p2_sql(), "p4_found": _p4_sql()}


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found}
