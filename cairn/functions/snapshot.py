"""Snapshot lines: exact parsing and rendering, closing white space, verification. JVM-side expressions, but for nested formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import digest, jsontext

#: The canonical line whose format holds no object of its own.
LINE = (
    r'(?s)\A\{"digest":"([A-Z2-7]{32})","(?:expected_digest":"([^"]{32})",")?(?:timestamp":"([0-9]{14})",")?(?:url":"([^"\\]*+)",")?'
    r'(?:format":(\{(?:[^{}"]++|"(?:[^"\\]++|\\.)*+")*+\}),")?content":(.*)\}\z'
)
#: The start of any canonical line with a format; all from the format on is its fifth group.
FORMATTED = r'(?s)\A\{"digest":"([A-Z2-7]{32})","(?:expected_digest":"([^"]{32})",")?(?:timestamp":"([0-9]{14})",")?(?:url":"([^"\\]*+)",")?format":(\{.*\})\z'
PARTS = ("digest", "expected_digest", "timestamp", "url", "format", "content")
CONTENT = ',"content":'
WHITESPACE = r"[\r\n \t]*\z"
CANDIDATES = ("\n", "\r\n", "\r\r\n")


def _nested(rests: pd.Series) -> pd.DataFrame:
    """The format and content of lines from the format on, which may be nested to any depth; nulls if they don't fit."""
    out = []
    for rest in rests:
        pair = (None, None)
        if isinstance(rest, str):
            try:
                form, end = jsontext.value_at(rest, 0)
                if rest.startswith(CONTENT, end) and not any(isinstance(form.get(k), (dict, list)) for k in ("type", "closing_whitespace")):
                    pair = (rest[:end], rest[end + len(CONTENT) : -1])
            except ValueError:
                pass
        out.append(pair)
    return pd.DataFrame(out, columns=["format", "content"], dtype=object)


def parse(line: Column) -> Column:
    """A struct of the six fields of a canonical line, all text, absent ones null; null for any other line.

    Only lines with an object within their format are read in Python, for all others it gets nulls.
    """
    plain = line.rlike(LINE)
    rest = F.when(~plain & line.rlike(FORMATTED), F.regexp_extract(line, FORMATTED, 5))
    has_url = F.instr(F.substring_index(F.substring_index(line, CONTENT[1:], 1), '"format":', 1), '"url":"') > 0

    def fields(pattern: str) -> dict[str, Column]:
        group = {p: F.regexp_extract(line, pattern, i) for i, p in enumerate(PARTS[: 6 if pattern == LINE else 4], 1)}
        return group | {p: F.nullif(group[p], F.lit("")) for p in ("expected_digest", "timestamp", "format") if p in group} | {"url": F.when(has_url, group["url"])}

    struct = lambda f: F.struct(*[f[p].alias(p) for p in PARTS])
    nested = F.pandas_udf(_nested, "struct<format:string,content:string>")(rest)
    return F.when(plain, struct(fields(LINE))).when(nested["format"].isNotNull(), struct(fields(FORMATTED) | {"format": nested["format"], "content": nested["content"]}))


def closing_whitespace(text: Column, default: str) -> Column:
    """The white space at a text's end where it isn't the default; else null."""
    return F.nullif(F.regexp_extract(text, WHITESPACE, 0), F.lit(default))


def format_type(form: Column) -> Column:
    return F.coalesce(F.get_json_object(form, "$.type"), F.lit("utf8"))


def effective_whitespace(form: Column, default: str) -> Column:
    return F.coalesce(F.get_json_object(form, "$.closing_whitespace"), F.lit(default))


def whitespace_is_sound(space: Column) -> Column:
    return space.rlike(r"\A[\r\n \t]*\z")


def verify(name: Column, content: Column, form: Column, default: str) -> Column:
    """ok, mismatch, unsupported_format or closing_whitespace, for a content as it stands in its line."""
    space = effective_whitespace(form, default)
    return (
        F.when(format_type(form) != "utf8", "unsupported_format")
        .when(~whitespace_is_sound(space), "closing_whitespace")
        .when(digest.sha1_base32(F.concat(content, space)) == name, "ok")
        .otherwise("mismatch")
    )


def unprocessed(text: Column) -> Column:
    """A struct (content, space, fault): a text without its closing white space, which must be a single line."""
    content = F.regexp_replace(text, WHITESPACE, "")
    return F.struct(content.alias("content"), F.regexp_extract(text, WHITESPACE, 0).alias("space"), F.when(content.rlike(r"[\r\n]"), "internal_line_break").alias("fault"))


def needs_escaping(text: Column) -> Column:
    return F.coalesce(text.rlike(r'["\\\x00-\x1f\x7f-\x9f]'), F.lit(False))


def render(name: Column, expected: Column, stamp: Column, url: Column, form: Column, content: Column, inferred: Column | None = None) -> Column:
    """The canonical line; a url that is inferred anyway is left out. Null where a value would need escapes."""
    part = lambda key, v: F.coalesce(F.concat(F.lit(f'"{key}":"'), v, F.lit('",')), F.lit(""))
    shown = url if inferred is None else F.when(~url.eqNullSafe(inferred), url)
    line = F.concat(F.lit('{"digest":"'), name, F.lit('",'), part("expected_digest", expected), part("timestamp", stamp), part("url", shown), F.coalesce(F.concat(F.lit('"format":'), form, F.lit(",")), F.lit("")), F.lit('"content":'), content, F.lit("}"))
    return F.when(~needs_escaping(expected) & ~needs_escaping(shown), line)


def escaped_whitespace(space: Column) -> Column:
    out = space
    for a, b in (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def inferred_url(content: Column) -> Column:
    """The post's URL by its user and id: data with includes.users first, else the flat shape; null where a part is missing or no text."""
    v = F.try_parse_json(content)
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    users = F.try_variant_get(v, "$.includes.users", "array<struct<id:string,username:string>>")
    author = text("$.data.author_id")
    name = F.get(F.filter(users, lambda u: u["id"] == author), F.lit(0))["username"]
    data = F.concat(F.lit("https://twitter.com/"), name, F.lit("/status/"), text("$.data.id"))
    flat = F.concat(F.lit("https://twitter.com/"), text("$.user.screen_name"), F.lit("/status/"), text("$.id_str"))
    return F.when(F.try_variant_get(v, "$.data", "variant").isNotNull(), data).otherwise(flat)
