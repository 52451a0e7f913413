import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cairn.functions import jsontext

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=4), v, max_size=4), max_leaves=12)


def plain(v):
    if isinstance(v, jsontext.Number):
        return int(v)
    if isinstance(v, list):
        return [plain(x) for x in v]
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


@given(VALUES)
def test_own_parser_agrees(value):
    text = json.dumps(value, indent=1)
    assert plain(jsontext._deep_value(text, 0)[0]) == value
    assert plain(jsontext.parse(text)) == value
    again = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    assert jsontext.canonical(jsontext.parse(text)) == jsontext.canonical(jsontext.parse(again))


def test_any_depth():
    text = "[" * 200_000 + "]" * 200_000
    assert jsontext.canonical(jsontext.parse(text)) == text


@pytest.mark.parametrize("bad", ["", " ", "NaN", "[1,]", '{"a":1,}', "{'a':1}", "01", '"\n"', "1 2", "[", '{"a" 1}', "﻿1", "-Infinity", "[[" * 3])
def test_strict(bad):
    with pytest.raises(ValueError):
        jsontext.parse(bad)
    with pytest.raises(ValueError):
        jsontext.members(bad)


def test_numbers_and_nulls():
    key = lambda t: jsontext.canonical(jsontext.parse(t))
    assert key("1") == key("1.0") == key("10e-1") == key("0.1E1") != key('"1"')
    assert key("-0") == key("0.0") and key("1e99999999") != key("1e99999998") and key("9" * 5000) != key("9" * 4999)
    assert key('{"a":null,"b":[null]}') == key('{"b":[null]}') != key('{"b":[]}')


def test_members_keep_their_text():
    line = ' { "a" : 1.0 , "b":{"x": [1 ,2]}, "a":"\\u00e9" } '
    assert [(n, t) for n, _, t in jsontext.members(line)] == [("a", "1.0"), ("b", '{"x": [1 ,2]}'), ("a", '"\\u00e9"')]


def test_exponents_of_any_length():
    long = "123456789" * 600
    key = jsontext.number_key
    assert key(f"1e{long}") == key(f"10e{int(long[-9:]) - 1:09}".replace("e", "e" + long[:-9])) != key(f"1e{long[:-1]}8")
    assert key(f"1e-{long}") == key(f"0.1e-{long[:-1]}8") and key("1e" + "9" * 5000) == key("0.1e1" + "0" * 5000) == key("100e" + "9" * 4999 + "7")
    assert key("1e00012") == key("10e+11") and key("0e" + long) == "0" and key("1e-" + "0" * 5000 + "3") == key("0.001")
