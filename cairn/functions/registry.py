"""User-supplied parts: format codecs, partition rules and classifiers, all as functions of columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import gzipformat, snapshot, urlrule

Decode = Callable[[Column], Column]
Encode = Callable[[Column, Column], Column]


@dataclass
class Context:
    """Default closing white space, codecs by format name, and how a content tells its URL."""

    closing_whitespace: str = "\n"
    infer_url: Callable[[Column], Column] | None = None
    codecs: dict[str, tuple[Decode, Encode]] = field(default_factory=dict)

    def register(self, name: str, decode: Decode, encode: Encode) -> Context:
        """Adds or replaces the codec of a format."""
        self.codecs[name] = (decode, encode)
        return self

    def encoded(self, content: Column, form: Column) -> Column:
        """The archived bytes of a content: text and closing white space for utf8, else by the codec; null if there is none."""
        kind = snapshot.format_type(form)
        text = F.encode(F.concat(content, snapshot.effective_whitespace(form, self.closing_whitespace)), "UTF-8")
        out = F.when(kind == "utf8", text)
        for name, (_, encode) in self.codecs.items():
            space = F.coalesce(F.get_json_object(form, "$.closing_whitespace"), F.lit(""))
            out = out.when(kind == name, encode(F.concat(content, space), form))
        return out

    @classmethod
    def load(cls, path: str) -> Context:
        """A context from a TOML or JSON file (closing_whitespace, url_query), with the gzip codec."""
        import json
        import tomllib

        with open(path, "rb") as f:
            given = json.load(f) if path.endswith(".json") else tomllib.load(f)
        rule = (given.get("url_query") or "").strip()
        out = cls(given.get("closing_whitespace", "\n"), urlrule.compiled(rule) if rule else None)
        return out.register("gzip", gzipformat.decompressed, gzipformat.encoded)
