"""The pN_ queries of this package, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import history, mixture, subjects, survivors, tokens
from cairn.plans import sqltext as q
from cairn.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "resolutions")
    group, usable = survivors.resolution_fields(df)
    return survivors.survivors(df, group, "res_id", usable, "trust", "seen_at").selectExpr("group as digest", "field", "row as res_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.repeats(table(spark, folder, "snapshots"), table(spark, folder, "download_results"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subjects(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas"))


def queries() -> dict:
    return {"p3_found": p3_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    bare = lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
    usable = {
        "timestamp": q.real(bare("timestamp")),
        "url": f"regexp_matches({bare('url')}, '^(?i:https?)://[^/?#:\\s]')",
        "expected_digest": f"{q.is_digest(q.clean('expected_digest'))} AND {q.clean('expected_digest')} <> d",
    }
    rows = " UNION ALL ".join(f"SELECT d, '{f}' AS field, res_id, trust, seen_at FROM k WHERE {u}" for f, u in usable.items())
    return {
        "p3_found": f"WITH g AS (SELECT *, {q.clean('digest')} AS d FROM resolutions), k AS (SELECT * FROM g WHERE {q.is_digest('d')}), n AS (SELECT d FROM k GROUP BY 1 HAVING count(*) > 1), t AS ({rows}) "
        "SELECT d AS digest, field, res_id FROM (SELECT *, row_number() OVER (PARTITION BY d, field ORDER BY trust DESC NULLS LAST, seen_at DESC NULLS LAST, res_id) AS r FROM t WHERE d IN (SELECT d FROM n)) WHERE r = 1"
    }
