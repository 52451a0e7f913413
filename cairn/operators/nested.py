"""Deeply nested records as related flat tables, by Dewey labels.

Every node of a document gets its Dewey label, the ordinals on the way from the root (an item's place in its array, a
member's place in its object). A parent's label is its child's label without the last ordinal, so parent links need no
lookup; nodes are grouped into tables by schema path, the names on the way with * for "any item".
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import jsontext

ITEM = "*"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_FIELDS = pa.map_(pa.string(), pa.string())


def step(name: str) -> str:
    """A member's name as a step of a schema path: ~, / and a lone * are escaped."""
    name = name.replace("~", "~0").replace("/", "~1")
    return "~2" if name == ITEM else name


def _scalar(value: object) -> str | None:
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return jsontext.storable(str(value))


def _kind(value: object) -> str:
    if value is None:
        return "null"
    return {dict: "object", list: "array", bool: "boolean", jsontext.Number: "number"}.get(type(value), "string")


def label_nodes(value: object, wanted: frozenset[str] | None = None) -> Iterator[tuple[list[int], str, str, str | None, list[tuple[str, str]]]]:
    """(label, schema path, kind, value, fields) of each node of a document, in document order."""
    branches = None
    if wanted is not None:
        branches = {p[:i] for p in wanted for i in range(1, len(p) + 1) if i == len(p) or p[i] == "/"} | {""}
    todo: list[tuple[object, list[int], str]] = [(value, [], "")]
    while todo:
        v, label, path = todo.pop()
        if branches is not None and path not in branches:
            continue
        if wanted is None or path in wanted:
            fields = [(jsontext.storable(k), s) for k, x in v.items() if (s := _scalar(x)) is not None] if type(v) is dict else []
            yield label, path, _kind(v), _scalar(v), fields
        if type(v) is dict:
            todo += [(x, [*label, i], f"{path}/{jsontext.storable(step(k))}") for i, (k, x) in reversed(list(enumerate(v.items())))]
        elif type(v) is list:
            todo += [(x, [*label, i], f"{path}/{ITEM}") for i, x in reversed(list(enumerate(v)))]


def dewey_nodes(df: DataFrame, key: str, document: str, paths: Iterable[str] | None = None) -> DataFrame:
    """One row for each node of each document, without any shuffle.

    Columns: the key; label array<int>; path (schema path, '' for the root); kind (object, array, string, number, boolean,
    null); value (text of a scalar, as written for numbers); fields (an object's scalar members by name, nulls left out).
    paths keeps only nodes of these schema paths, and whole branches that lead to none of them are not visited.

    A text that holds JSON within a JSON string counts as the JSON inside. Null, empty and invalid documents have no nodes.
    Of members of one name in one object the last counts. A null key is kept as null; rows that repeat a key give their
    nodes each. Other columns of df, whatever their names, aren't read. Documents may nest to any depth.
    """
    wanted = None if paths is None else frozenset(paths)
    kind = dict(df.dtypes)[key]
    key_type = _ARROW.get(kind, pa.string())
    schema = pa.schema([("key", key_type), ("label", pa.list_(pa.int32())), ("path", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("fields", _FIELDS)])

    def shred(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = jsontext.unwrapped(text)
                except ValueError:
                    continue
                for node in label_nodes(value, wanted):
                    rows[0].append(k)
                    for column, x in zip(rows[1:], node):
                        column.append(x)
                if len(rows[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                    rows = ([], [], [], [], [], [])
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    key_sql = kind if kind in _ARROW else "string"
    slim = df.select(df[key].cast(key_sql).alias("key"), df[document].cast("string").alias("document"))
    return slim.mapInArrow(shred, f"key {key_sql}, label array<int>, path string, kind string, value string, fields map<string,string>").withColumnRenamed("key", key)


def truncated(label: Column, steps: int = 1) -> Column:
    """The label of the ancestor so many steps up; null above the root."""
    return F.when(F.size(label) >= steps, F.slice(label, F.lit(1), F.size(label) - F.lit(steps)))


def label_text(label: Column) -> Column:
    return F.array_join(F.transform(label, lambda x: x.cast("string")), ".")


@dataclass(frozen=True)
class Table:
    """The records under some schema paths (alternatives, such as a single object and an item), and the table of their parents."""

    paths: tuple[str, ...]
    columns: tuple[str, ...] = ()
    parent: str | None = None


def _chain(layout: dict[str, Table], name: str) -> list[Table]:
    """The table, its parent, and so on."""
    chain, at = [], layout.get(name)
    while at is not None:
        chain.append(at)
        at = layout.get(at.parent) if at.parent else None
    return chain


def _is_record() -> Column:
    return (F.col("kind") != "null") & ((F.col("kind") != "array") | (F.substring_index("path", "/", -1) == ITEM))


def _by_variant(table: Table, of: Callable[[str], Column]) -> Column:
    """of(variant) for the longest of the table's paths that leads to the node."""
    out = F.lit(None)
    for variant in sorted(table.paths, key=len):
        out = F.when((F.col("path") == variant) | F.col("path").startswith(variant + "/"), of(variant)).otherwise(out)
    return out


def _places(layout: dict[str, Table], name: str) -> Column:
    place = lambda v: F.element_at("label", v.count("/")) if v.endswith("/" + ITEM) else F.lit(0)
    return F.array(*[_by_variant(t, place).cast("int") for t in _chain(layout, name)])


def relation(nodes: DataFrame, key: str, layout: dict[str, Table], name: str) -> DataFrame:
    """One table of the layout, from nodes.

    Columns: key, label, parent (the parent record's label, by truncation; null at the top), places (of the record and its
    ancestor records, the record's own first; 0 where a single value stands in place of an array), kind, value, fields,
    and a column for each named scalar member. Null nodes are left out, but they took a place; so is an array that holds
    the records, which isn't one itself.
    """
    chain = _chain(layout, name)
    parent = _by_variant(chain[1], lambda v: F.slice("label", 1, v.count("/"))) if len(chain) > 1 else F.lit(None)
    return nodes.where(F.col("path").isin(*chain[0].paths) & _is_record()).select(
        key, "label", parent.cast("array<int>").alias("parent"), _places(layout, name).alias("places"),
        "kind", "value", "fields", *[F.col("fields")[c].alias(c) for c in chain[0].columns],
    )


def tables(nodes: DataFrame, key: str, layout: dict[str, Table]) -> dict[str, DataFrame]:
    """All tables of the layout."""
    return {name: relation(nodes, key, layout, name) for name in layout}


def paths_of(layout: dict[str, Table]) -> set[str]:
    return {p for t in layout.values() for p in t.paths}


def kinds_of_records(nodes: DataFrame, key: str, layout: dict[str, Table], child_key: dict[str, str | None]) -> DataFrame:
    """All tables of the layout in one pass over the nodes, as (key, rel, places, child_key).

    child_key names the scalar member of each table that tells its records, None for the node's own value; '' where absent.
    """
    route = F.lit(None).cast("string")
    for name, table in layout.items():
        route = F.when(F.col("path").isin(*table.paths), F.lit(name)).otherwise(route)
    routed = nodes.withColumn("rel", route).where(F.col("rel").isNotNull() & _is_record())
    places, child = F.lit(None).cast("array<int>"), F.lit(None).cast("string")
    for name, member in child_key.items():
        places = F.when(F.col("rel") == name, _places(layout, name)).otherwise(places)
        child = F.when(F.col("rel") == name, F.col("value") if member is None else F.col("fields")[member]).otherwise(child)
    return routed.select(key, "rel", places.alias("places"), F.coalesce(child, F.lit("")).alias("child_key"))
