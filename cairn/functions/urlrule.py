"""Rules that tell a content's URL, in a subset of the Common Expression Language, as column expressions.

Understood: 'text', "text", whole numbers, true, false, the variable content, members a.b, indexes a[0], a.filter(x, cond),
has(a.b), + (texts), ==, !=, &&, ||, !, cond ? a : b and parentheses. As in the language nothing is converted: adding a
number to a text, a missing member or an index out of range make the whole rule null, as does a result that is no text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<text>'[^'\\]*'|"[^"\\]*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|&&|\|\||[-+!?:.,()\[\]]))""")


@dataclass(frozen=True)
class _Value:
    kind: str  # variant, text, bool or number
    column: Column

    def text(self) -> Column:
        if self.kind == "text":
            return self.column
        if self.kind == "variant":
            return F.when(F.schema_of_variant(self.column) == "STRING", F.try_variant_get(self.column, "$", "string"))
        return F.lit(None).cast("string")

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.column
        return F.when(F.schema_of_variant(self.column) == "BOOLEAN", F.try_variant_get(self.column, "$", "boolean")) if self.kind == "variant" else F.lit(None).cast("boolean")

    def number(self) -> Column:
        if self.kind == "number":
            return self.column
        return F.when(F.schema_of_variant(self.column) == "BIGINT", F.try_variant_get(self.column, "$", "bigint")) if self.kind == "variant" else F.lit(None).cast("bigint")

    def equals(self, other: _Value) -> Column:
        return F.coalesce(self.text() == other.text(), self.number() == other.number(), self.truth() == other.truth(), F.lit(False))


class _Parser:
    def __init__(self, rule: str, content: Column):
        self.tokens, at, rule = [], 0, rule.rstrip()
        while at < len(rule):
            m = _TOKEN.match(rule, at)
            if not m:
                raise ValueError(f"rule not understood at {rule[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.names = 0, {"content": content}

    def take(self, *signs: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind == "sign" and value in signs:
            self.at += 1
            return value
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"{sign} expected, not {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise ValueError(f"a name expected, not {value!r}")
        self.at += 1
        return value

    def choice(self) -> _Value:
        test = self.any_of()
        if not self.take("?"):
            return test
        yes = self.choice()
        self.need(":")
        no = self.choice()
        return _Value("text", F.when(test.truth(), yes.text()).when(~test.truth(), no.text()))

    def any_of(self) -> _Value:
        left = self.all_of()
        while self.take("||"):
            left = _Value("bool", left.truth() | self.all_of().truth())
        return left

    def all_of(self) -> _Value:
        left = self.compared()
        while self.take("&&"):
            left = _Value("bool", left.truth() & self.compared().truth())
        return left

    def compared(self) -> _Value:
        left = self.added()
        while sign := self.take("==", "!="):
            same = left.equals(self.added())
            left = _Value("bool", same if sign == "==" else ~same)
        return left

    def added(self) -> _Value:
        left = self.single()
        while self.take("+"):
            left = _Value("text", F.concat(left.text(), self.single().text()))
        return left

    def single(self) -> _Value:
        if self.take("!"):
            return _Value("bool", ~self.single().truth())
        kind, value = self.tokens[self.at]
        if self.take("("):
            out = self.choice()
            self.need(")")
        elif kind == "text":
            self.at += 1
            out = _Value("text", F.lit(value[1:-1]))
        elif kind == "number":
            self.at += 1
            out = _Value("number", F.lit(int(value)))
        else:
            name = self.name()
            if name == "has":
                self.need("(")
                found = self.path(self.variable(self.name()))
                self.need(")")
                return _Value("bool", found.column.isNotNull())
            out = _Value("bool", F.lit(name == "true")) if name in ("true", "false") else self.variable(name)
        return self.path(out)

    def variable(self, name: str) -> _Value:
        if name not in self.names:
            raise ValueError(f"unknown name {name}")
        return _Value("variant", self.names[name])

    def path(self, value: _Value) -> _Value:
        while True:
            if self.take("."):
                name = self.name()
                if name == "filter" and self.take("("):
                    value = self.filtered(value)
                else:
                    value = _Value("variant", F.try_variant_get(value.column, f"$['{name}']", "variant"))
            elif self.take("["):
                kind, number = self.tokens[self.at]
                if kind != "number":
                    raise ValueError("an index must be a whole number")
                self.at += 1
                self.need("]")
                value = _Value("variant", F.get(value.column, F.lit(int(number))) if value.kind == "list" else F.try_variant_get(value.column, f"$[{number}]", "variant"))
            else:
                return value

    def filtered(self, value: _Value) -> _Value:
        name = self.name()
        self.need(",")
        begin = self.at

        def test(item: Column) -> Column:
            before, self.at, hidden = self.at, begin, self.names.get(name)
            self.names[name] = item
            try:
                return F.coalesce(self.any_of().truth(), F.lit(False))
            finally:
                self.names = {k: v for k, v in self.names.items() if k != name} | ({name: hidden} if hidden is not None else {})
                self.end, self.at = self.at, before

        kept = F.filter(F.try_variant_get(value.column, "$", "array<variant>"), test)
        self.at = self.end
        self.need(")")
        return _Value("list", kept)


def compiled(rule: str) -> Callable[[Column], Column]:
    """The rule as a function from a column of JSON texts to a column of URLs; ValueError for what isn't understood."""

    def infer(content: Column) -> Column:
        p = _Parser(rule, F.try_parse_json(content))
        out = p.choice()
        if p.tokens[p.at][0] != "end":
            raise ValueError(f"rule not understood at {p.tokens[p.at][1]!r}")
        return out.text()

    return infer
