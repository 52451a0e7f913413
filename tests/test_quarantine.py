import base64
import csv
import datetime
import hashlib
import json
import re

import pandas as pd
import pytest

from cairn.operators import quarantine
from cairn.plans import problems


def real(t):
    if not re.fullmatch("[0-9]{14}", t or "") or t[0] == "0":
        return False
    try:
        datetime.datetime.strptime(t, "%Y%m%d%H%M%S")
    except ValueError:
        return False
    return t[12:] < "60"


def digest(content, space="\n"):
    return base64.b32encode(hashlib.sha1((content + space).encode()).digest()).decode()


def snapshot_reason(line):
    decoder = json.JSONDecoder(object_pairs_hook=list, parse_constant=lambda x: 1 / 0)
    try:
        pairs = decoder.decode(line)
        v = json.loads(line)
    except (ValueError, ZeroDivisionError):
        return "schema_error"
    names = [p[0] for p in pairs] if isinstance(v, dict) else None
    order = ["digest", "expected_digest", "timestamp", "url", "format", "content"]
    if names is None or [n for n in order if n in names] != names or "digest" not in names or "content" not in names:
        return "schema_error"
    if not re.fullmatch("[A-Z2-7]{32}", str(v["digest"])) or ("timestamp" in v and not (isinstance(v["timestamp"], str) and real(v["timestamp"]))):
        return "schema_error"
    f = v.get("format") if isinstance(v.get("format"), dict) else {}
    if f.get("type", "utf8") != "utf8":
        return "unsupported_format"
    at = re.search(r'"content"\s*:\s*', line).end()  # content is the last member; brute force strips the final brace
    content = line[at : line.rindex("}")].rstrip()
    return None if digest(content, f.get("closing_whitespace", "\n")) == v["digest"] else "digest_mismatch"


def queue_reason(line):
    try:
        fields = next(csv.reader([line], strict=True, doublequote=True))
    except csv.Error:
        return "broken_quoting"
    rest = re.sub(r'(^|,)"(?:[^"]|"")*"(?=,|$)', r"\1", line)
    if '"' in rest:
        return "broken_quoting"
    if len(fields) != 3:
        return "column_count"
    return None if real(fields[1]) and re.match("https?://", fields[0]) else "invalid_value"


def test_against_brute_force(spark, folder):
    d = pd.read_parquet(f"{folder}/raw_lines.parquet")
    want = {}
    for i, kind, line in zip(d.line_id, d.kind, d.line):
        line = line.removesuffix("\r")
        if line.strip():
            want[i] = (snapshot_reason if kind == "snapshot" else queue_reason)(line)
    got = {r.line_id: r.reason for r in problems.p5_found(spark, folder).collect()}
    assert got == {i: r for i, r in want.items() if r}


GOOD = f'{{"digest":"{digest("[1, 2]")}","content":[1, 2]}}'
CASES = [
    ("snapshot", GOOD, None),
    ("snapshot", GOOD + "\r", None),
    ("snapshot", GOOD + "\r\r", None),
    ("snapshot", " " + GOOD.replace(":", " : ", 1), None),
    ("snapshot", GOOD.replace("1, 2", "1,2"), "digest_mismatch"),
    ("snapshot", GOOD.replace('"content"', '"timestamp":"20200230000000","content"'), "schema_error"),
    ("snapshot", GOOD.replace('"content"', '"timestamp":"09990101000000","content"'), "schema_error"),
    ("snapshot", GOOD.replace('"content"', '"timestamp":null,"content"'), "schema_error"),
    ("snapshot", GOOD.replace('"content"', '"format":{"type":"gzip"},"content"'), "unsupported_format"),
    ("snapshot", GOOD.replace('"content"', '"format":{"closing_whitespace":"\\n"},"content"'), None),
    ("snapshot", GOOD.replace('"content"', '"digest":"x","content"'), "schema_error"),
    ("snapshot", "", "blank"),
    ("snapshot", "   \r", "blank"),
    ("snapshot", None, "blank"),
    ("queue", "https://a.test/,20200101000000,X", None),
    ("queue", '"https://a.test/?a=""1,2""",20200101000000,', None),
    ("queue", '"https://a.test/,20200101000000,X', "broken_quoting"),
    ("queue", '"https://a.test/"x,20200101000000,X', "broken_quoting"),
    ("queue", 'https://a.test/"x",1', "broken_quoting"),
    ("queue", "https://a.test/,20200101000000", "column_count"),
    ("queue", "https://a.test/,20200101000000,X,", "column_count"),
    ("queue", "HTTPS://a.test/,20200101000000,X", "invalid_value"),
    ("queue", "https://a.test/,20200101006000,X", "invalid_value"),
    ("queue", '"' + '""' * 100_000 + '",1,2', "invalid_value"),
    (None, "x", "unknown_kind"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, k, x, "clash") for i, (k, x, _) in enumerate(CASES)], "line_id int, kind string, line string, shape string")
    loaded = {r.line_id: (r.errors or [None])[0] for r in quarantine.load_lines(df, "line_id").collect()}
    assert {i: loaded.get(i, "blank") for i in range(len(CASES))} == {i: c[2] for i, c in enumerate(CASES)}
    good, bad = quarantine.split(quarantine.load_lines(df, "line_id"))
    assert good.count() + bad.count() == len(loaded) and "errors" not in good.columns
    assert quarantine.load_lines(df.limit(0), "line_id").count() == 0


@pytest.mark.parametrize("line,fields,sound", [("", [""], True), (",", ["", ""], True), ('"a,b",c', ["a,b", "c"], True), ('""', [""], True), ('"', [], False), ('a"', [], False), ('"a" ,b', ["a"], False)])
def test_csv_fields(line, fields, sound):
    assert quarantine.csv_fields(line)[1] is sound
    assert not sound or quarantine.csv_fields(line)[0] == fields
