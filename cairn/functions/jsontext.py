"""Strict JSON in the Python workers: parsing to any depth, canonical text, spans of members.

Numbers stay as they are written (class Number), so that long ids lose no digit.
"""

from __future__ import annotations

import json
import re


class Number(str):
    """A JSON number as written."""

    __slots__ = ()


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)
_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_WORDS = {"true": True, "false": False, "null": None}


def value_at(text: str, at: int) -> tuple[object, int]:
    """The JSON value that begins at a place, and the place after it; ValueError if there is none."""
    try:
        return _DECODER.raw_decode(text, at)
    except RecursionError:
        return _deep_value(text, at)


def parse(text: str) -> object:
    """The value of one strict JSON text; ValueError for anything else."""
    value, end = value_at(text, _BLANK.match(text).end())
    if _BLANK.match(text, end).end() != len(text):
        raise ValueError("text after the value")
    return value


def _deep_value(text: str, at: int) -> tuple[object, int]:
    """value_at with a stack of its own, for nesting beyond what the interpreter's stack takes."""
    stack: list[tuple[object, object]] = []
    while True:
        at = _BLANK.match(text, at).end()
        c = text[at : at + 1]
        if c == "{" or c == "[":
            box: object = {} if c == "{" else []
            end = _BLANK.match(text, at + 1).end()
            if text[end : end + 1] == ("}" if c == "{" else "]"):
                value, at = box, end + 1
            else:
                key, at = _member_name(text, end) if c == "{" else (None, end)
                stack.append((box, key))
                continue
        elif c == '"':
            if not (m := _STRING.match(text, at)):
                raise ValueError("bad string")
            value, at = json.loads(m[0]), m.end()
        elif m := _NUMBER.match(text, at):
            value, at = Number(m[0]), m.end()
        else:
            for word, value in _WORDS.items():
                if text.startswith(word, at):
                    at += len(word)
                    break
            else:
                raise ValueError("no value")
        while stack:
            box, key = stack[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            at = _BLANK.match(text, at).end()
            c = text[at : at + 1]
            if c == ",":
                key, at = _member_name(text, _BLANK.match(text, at + 1).end()) if isinstance(box, dict) else (None, at + 1)
                stack[-1] = (box, key)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("comma or end expected")
            stack.pop()
            value, at = box, at + 1
        else:
            return value, at


def _member_name(text: str, at: int) -> tuple[str, int]:
    if not (m := _STRING.match(text, at)):
        raise ValueError("name expected")
    at = _BLANK.match(text, m.end()).end()
    if text[at : at + 1] != ":":
        raise ValueError("colon expected")
    return json.loads(m[0]), at + 1


def members(text: str) -> list[tuple[str, object, str]]:
    """Name, value and exact text of each member of the one object that a text holds; ValueError if it isn't one."""
    at = _BLANK.match(text).end()
    if text[at : at + 1] != "{":
        raise ValueError("no object")
    out: list[tuple[str, object, str]] = []
    at = _BLANK.match(text, at + 1).end()
    if text[at : at + 1] == "}":
        at += 1
    else:
        while True:
            name, at = _member_name(text, at)
            at = _BLANK.match(text, at).end()
            value, end = value_at(text, at)
            out.append((name, value, text[at:end]))
            at = _BLANK.match(text, end).end()
            c = text[at : at + 1]
            at += 1
            if c == "}":
                break
            if c != ",":
                raise ValueError("comma expected")
            at = _BLANK.match(text, at).end()
    if _BLANK.match(text, at).end() != len(text):
        raise ValueError("text after the object")
    return out


def number_key(number: str) -> str:
    """Numbers of equal value get equal text, whatever way they are written."""
    mantissa, _, exponent = number.lower().partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    bare = digits.rstrip("0")
    return f"{sign}{bare}e{_exponent(exponent, len(digits) - len(bare) - len(part))}" if bare else "0"


def _exponent(text: str, shift: int) -> str:
    """An exponent of any length plus a shift, as text; beyond what Python converts at once by its last digits and a carry."""
    sign, digits = ("-" if text[:1] == "-" else ""), text.lstrip("+-").lstrip("0")
    if len(digits) < 4000:
        return str(int(f"{sign}{digits or 0}") + shift)
    low = int(digits[-1000:]) + (-shift if sign else shift)  # a shift has far fewer digits
    if 0 <= low < 10**1000:
        return f"{sign}{digits[:-1000]}{low:01000}"
    carry, low = divmod(low, 10**1000)
    high = list(digits[:-1000])
    at = len(high) - 1
    turn, ends = ("9", "0") if carry > 0 else ("0", "9")
    while at >= 0 and high[at] == turn:
        high[at], at = ends, at - 1
    if at < 0:
        high.insert(0, "1")
    else:
        high[at] = str(int(high[at]) + carry)
    return f"{sign}{''.join(high).lstrip('0')}{low:01000}"


_QUOTE = json.encoder.encode_basestring_ascii


def canonical(value: object, null_is_absent: bool = True) -> str:
    """One text for all ways to write a value: sorted names, no blanks, ASCII escapes, plain numbers."""
    out: list[str] = []
    todo: list[object] = [value]
    while todo:
        v = todo.pop()
        kind = type(v)
        if kind is str:
            out.append(_QUOTE(v))
        elif kind is _Token:
            out.append(v.text)
        elif kind is Number:
            out.append(number_key(v))
        elif v is None:
            out.append("null")
        elif kind is bool:
            out.append("true" if v else "false")
        elif kind is list:
            out.append("[")
            todo.append(_CLOSE_LIST)
            for i in range(len(v) - 1, -1, -1):
                todo += (v[i], _COMMA) if i else (v[i],)
        else:
            out.append("{")
            todo.append(_CLOSE_OBJECT)
            names = sorted(k for k, x in v.items() if x is not None or not null_is_absent)
            for i in range(len(names) - 1, -1, -1):
                todo += (v[names[i]], _Token(("," if i else "") + _QUOTE(names[i]) + ":"))
    return "".join(out)


class _Token:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


_CLOSE_LIST, _CLOSE_OBJECT, _COMMA = _Token("]"), _Token("}"), _Token(",")


def storable(text: str) -> str:
    """text with lone surrogates, which UTF-8 can't hold, replaced by U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def unwrapped(text: str | None) -> object:
    """The value of a content; where that is a text that holds JSON, the value inside. ValueError for no JSON or null text."""
    if text is None:
        raise ValueError("null")
    value = parse(text)
    return parse(value) if type(value) is str else value
