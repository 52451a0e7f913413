"""Differences between two copies of a data set, field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import jsontext

PAIR = "struct<field:string,first:string,second:string>"


def line_fields(line: Column, fields: Sequence[str]) -> Column:
    """A struct of the fields of a line that is one JSON object, each as canonical JSON text.

    Ways of writing (order of names, blanks, escapes, 1 or 1.0) don't show in it; a null member is as an absent one, on
    every level; of repeated names the last counts. A line that is no JSON object has its whole text under the last field,
    marked as broken; a null line gives nulls.
    """
    names = list(fields)

    @F.pandas_udf(f"struct<{','.join(f'`{n}`:string' for n in names)}>")
    def of(lines: pd.Series) -> pd.DataFrame:
        columns: dict[str, list[str | None]] = {n: [] for n in names}
        for line in lines:
            value: object = {}
            if isinstance(line, str):
                try:
                    value = jsontext.parse(line)
                    if type(value) is not dict:
                        raise ValueError("no object")
                except ValueError:
                    value = {names[-1]: {"broken": line}}
            for n in names:
                columns[n].append(None if value.get(n) is None else jsontext.canonical(value[n]))
        return pd.DataFrame(columns)

    return of(line)


def compare_copies(first: DataFrame, second: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows missing on either side and the fields that differ, matched null-safely on the key.

    Columns: the key; side ('first' or 'second' for keys of that copy only, else 'both'); differences, an array of (field,
    first, second). Keys on both sides without a difference are left out. The fields are compared null-safely as they
    are: bring them to a normal form first. Null keys match each other.

    A key may have several rows in a copy; equal rows count once, and the sets of rows are compared, whatever their
    number. A field differs if its set of values does; shown is the least value that only that copy has, or its least
    value if it has none of its own. Should no field's values differ but the rows do (the same values, combined in
    another way), the fields differ that vary among the rows of one copy only, shown with the least values.
    All steps are partial aggregates by key and row or value, so that a key with very many rows is spread over tasks.
    """
    sides = [df.select(df[key].alias("k"), *[df[f].cast("string").alias(f"f{i}") for i, f in enumerate(fields)], F.lit(n == 0).alias("a"), F.lit(n == 1).alias("b")) for n, df in enumerate((first, second))]
    there = [F.max(x).alias(x) for x in ("a", "b")]
    rows = sides[0].unionByName(sides[1]).groupBy("k", *[f"f{i}" for i in range(len(fields))]).agg(*there)
    each = rows.select("k", "a", "b", (F.col("a") != F.col("b")).alias("lone"), F.posexplode(F.array(*[f"f{i}" for i in range(len(fields))])).alias("i", "value"))
    values = each.groupBy("k", "i", "value").agg(*there, F.max("lone").alias("lone"))

    told = list(there)
    for i in range(len(fields)):
        at = F.col("i") == i
        told.append(F.count_if(at & F.col("lone")).alias(f"lone_{i}"))
        for x, y in (("a", "b"), ("b", "a")):
            own = at & F.col(x) & ~F.col(y)
            told += [F.count_if(own).alias(f"{x}_owns_{i}"), F.min(F.when(own, F.col("value"))).alias(f"{x}_own_{i}"), F.min(F.when(at & F.col(x), F.col("value"))).alias(f"{x}_least_{i}")]
    keys = values.groupBy("k").agg(*told)

    differ = [(F.col(f"a_owns_{i}") + F.col(f"b_owns_{i}")) > 0 for i in range(len(fields))]
    any_differs = reduce(or_, differ)
    shown = lambda x, i: F.when(F.col(f"{x}_owns_{i}") > 0, F.col(f"{x}_own_{i}")).otherwise(F.col(f"{x}_least_{i}"))
    pairs = [F.when(differ[i] | (~any_differs & (F.col(f"lone_{i}") > 1)), F.struct(F.lit(f).alias("field"), shown("a", i).alias("first"), shown("b", i).alias("second"))) for i, f in enumerate(fields)]
    side = F.when(~F.col("b"), "first").when(~F.col("a"), "second").otherwise("both")
    out = keys.select(F.col("k").alias(key), side.alias("side"), F.when(F.col("a") & F.col("b"), F.array_compact(F.array(*pairs))).otherwise(F.array().cast(f"array<{PAIR}>")).alias("differences"))
    return out.where((F.col("side") != "both") | (F.size("differences") > 0))


def found_differences(differences: DataFrame, key: str) -> DataFrame:
    """One row for each difference: (key, side, field), field being '' for a key that one copy lacks."""
    names = F.when(F.col("side") == "both", F.transform("differences", lambda d: d["field"])).otherwise(F.array(F.lit("")))
    return differences.select(key, "side", F.explode(names).alias("field"))


def copies_of_lines(first: DataFrame, second: DataFrame, key: Column, lines: Mapping[str, str], fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The two copies as (digest, fields…), ready for compare_copies; lines names the line column of each."""
    out = []
    for df, side in ((first, "first"), (second, "second")):
        parsed = df.select(key.alias("digest"), line_fields(df[lines[side]], fields).alias("line"))
        out.append(parsed.select("digest", *[F.col("line")[f].alias(f) for f in fields]))
    return out[0], out[1]
