"""Loading rows that may be broken: all columns as text, rules as error arrays, good and bad rows apart."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import digest, jsontext, times

#: The fields of a snapshot line, in their order.
SNAPSHOT_FIELDS = ("digest", "expected_digest", "timestamp", "url", "format", "content")
QUEUE_FIELDS = ("url", "timestamp", "expected_digest")

Rule = tuple[str, Column]


def errors(rules: Sequence[Rule]) -> Column:
    """The reasons, in the order of the rules, whose condition holds; a condition that is null holds not."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(reason)) for reason, broken in rules]))


def judged(df: DataFrame, rules: Sequence[Rule], into: str = "errors") -> DataFrame:
    return df.withColumn(into, errors(rules))


def split(df: DataFrame, column: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, bad rows with it); an empty array means good."""
    return df.where(F.size(column) == 0).drop(column), df.where(F.size(column) > 0)


_OPEN = re.compile(r'"((?:[^"]|"")*)("?)')


def csv_fields(line: str) -> tuple[list[str], bool]:
    """The fields of a line and whether its quoting is sound; where it isn't, the fields before the fault."""
    fields: list[str] = []
    at = 0
    while True:
        if line.startswith('"', at):
            m = _OPEN.match(line, at)
            if not m[2]:
                return fields, False
            fields.append(m[1].replace('""', '"'))
            at = m.end()
            if at < len(line) and line[at] != ",":
                return fields, False
        else:
            end = line.find(",", at)
            field = line[at:] if end < 0 else line[at:end]
            if '"' in field:
                return fields, False
            fields.append(field)
            at += len(field)
        if at >= len(line):
            return fields, True
        at += 1


def _snapshot(line: str) -> dict[str, str | None]:
    """The fields of a snapshot line as text; no 'shape' unless it is an object with the right fields in the right order."""
    try:
        members = jsontext.members(line)
    except ValueError:
        return {}
    names = [n for n, _, _ in members]
    out: dict[str, str | None] = {}
    for name, value, text in members:
        if name == "content":
            out["content"] = text
        elif name == "format":
            out["format"] = text
            if type(value) is dict:
                kind, space = value.get("type", "utf8"), value.get("closing_whitespace", "\n")
                out["format_type"] = kind if type(kind) is str else jsontext.canonical(kind)
                out["closing_whitespace"] = space if type(space) is str else "\n" if space is None else None
                if kind is None:
                    out["format_type"] = "utf8"
        elif type(value) is str and name in SNAPSHOT_FIELDS:
            out[name] = value
    places = [SNAPSHOT_FIELDS.index(n) if n in SNAPSHOT_FIELDS else -1 for n in names]
    sound = all(p >= 0 for p in places) and all(a < b for a, b in zip(places, places[1:])) and {"digest", "content"} <= set(names)
    sound = sound and ("timestamp" not in names or "timestamp" in out)
    out["shape"] = "snapshot" if sound else None
    return {k: v if v is None else jsontext.storable(v) for k, v in out.items()}


LOADED = ("shape", "digest", "expected_digest", "timestamp", "url", "format", "format_type", "closing_whitespace", "content")


def loaded_fields(kind: Column, line: Column) -> Column:
    """A struct of nullable texts for a line of kind snapshot (its JSON members) or queue (its CSV fields).

    shape tells what the line is: 'snapshot' if its members are the right ones, for queues 'broken' or the number of
    fields; null for all else. content is the exact text of the member, not a new rendering of it.
    """

    @F.pandas_udf(f"struct<{','.join(f'{n}:string' for n in LOADED)}>")
    def of(kinds: pd.Series, lines: pd.Series) -> pd.DataFrame:
        rows = []
        for k, x in zip(kinds, lines):
            row: dict[str, str | None] = {}
            if not isinstance(x, str):
                pass
            elif k == "queue":
                fields, sound = csv_fields(x)
                row = {"shape": str(len(fields)) if sound else "broken"} | (dict(zip(QUEUE_FIELDS, fields)) if sound else {})
            elif k == "snapshot":
                row = _snapshot(x)
            rows.append([row.get(n) for n in LOADED])
        return pd.DataFrame(rows, columns=list(LOADED), dtype=object)

    return of(kind, line)


def line_rules() -> list[Rule]:
    """The rules for loaded lines, in the order in which the first reason counts."""
    c = F.col
    snapshot, queue = c("kind") == "snapshot", c("kind") == "queue"
    bad_time = c("timestamp").isNotNull() & ~times.is_real(c("timestamp"))
    body = F.concat(c("content"), F.coalesce(c("closing_whitespace"), F.lit("\n")))
    return [
        ("schema_error", snapshot & (c("shape").isNull() | ~digest.is_digest(c("digest")) | bad_time)),
        ("unsupported_format", snapshot & c("format_type").isNotNull() & (c("format_type") != "utf8")),
        ("digest_mismatch", snapshot & ~F.coalesce(digest.sha1_base32(body) == c("digest"), F.lit(False))),
        ("broken_quoting", queue & (c("shape") == "broken")),
        ("column_count", queue & (c("shape") != "3")),
        ("invalid_value", queue & (~times.is_real(c("timestamp")) | ~F.coalesce(c("url").rlike("^https?://"), F.lit(False)))),
    ]


def load_lines(df: DataFrame, key: str, kind: str = "kind", line: str = "line") -> DataFrame:
    """Each line that isn't blank, loaded as nullable text, with its array of errors (empty for good lines).

    Columns: key, kind, the loaded fields, errors. A CR at the line's end isn't part of it. Null lines count as blank. Lines
    of a null or unknown kind have no rules: they come out with the error 'unknown_kind'. Other columns aren't carried.
    """
    text = F.regexp_replace(df[line].cast("string"), r"\r\z", "")
    rows = df.select(df[key], df[kind].alias("kind"), text.alias("line")).where(F.col("line").rlike(r"(?U)\S"))
    loaded = rows.select(key, "kind", loaded_fields(F.col("kind"), F.col("line")).alias("f")).select(key, "kind", "f.*")
    unknown = ("unknown_kind", ~F.coalesce(F.col("kind").isin("snapshot", "queue"), F.lit(False)))
    return judged(loaded, [*line_rules(), unknown])
