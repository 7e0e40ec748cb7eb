from __future__ import annotations

import csv
import datetime as dt
import io
import json
import random

import pytest

from graphloom.sources import raw_records

FILES = [
    (1, "copy_outcome", "csv", ";"), (2, "node_body", "csv", ","), (3, "node_body", "jsonl", None), (4, "copy_outcome", "csv", None),
    (5, "other", "csv", ","),
]


def load(spark, lines, files=FILES):
    shapes = spark.createDataFrame([(*f, None) for f in files], "file_no int, layout string, format string, delimiter string, loaded_at timestamp_ntz")
    raw = spark.createDataFrame([(*x, "clash") for x in lines], "file_no int, line_no int, line string, reason string")
    return raw_records.load_records(raw, shapes)


CASES = [
    (1, "7;City;nodes;12;2031-02-03T04:05:06Z", None), (1, "7;City;nodes;12;2031-02-03T04:05:06Z\r", None),
    (1, '"7";"a;b";nodes;"9223372036854775807";2031-02-03T04:05:06Z', None), (1, '7;"line\nbreak";nodes;1;2031-02-03T04:05:06Z', None),
    (1, '7;"line\r\nbreak";nodes;1;2031-02-03T04:05:06Z', None), (1, "7;a\nb;nodes;1;2031-02-03T04:05:06Z", None),
    (1, "7;City;nodes;9223372036854775808;2031-02-03T04:05:06Z", "invalid_value"), (1, "007;City;nodes;000;2031-02-03T04:05:06Z", None),
    (1, "0000000000000000000000001;City;nodes;1;2031-02-03T04:05:06Z", None), (1, "7;;nodes;1;2031-02-03T04:05:06Z", "invalid_value"),
    (1, "7;City;Nodes;1;2031-02-03T04:05:06Z", "invalid_value"), (1, "7;City;nodes; 1;2031-02-03T04:05:06Z", "invalid_value"),
    (1, "7;City;nodes;-1;2031-02-03T04:05:06Z", "invalid_value"), (1, "7;City;nodes;1;2031-02-30T04:05:06Z", "invalid_value"),
    (1, "7;City;nodes;1;2032-02-29T04:05:06Z", None), (1, "7;City;nodes;1;2031-02-03T24:00:00Z", "invalid_value"),
    (1, "7;City;nodes;1;2031-02-03 04:05:06Z", "invalid_value"), (1, "7;City;nodes;1", "column_count"), (1, "", "column_count"),
    (1, None, "column_count"), (1, "7;City;nodes;1;2031-02-03T04:05:06Z;", "column_count"), (1, '7;Ci"ty;nodes;1;x', "quoting"),
    (1, '"7;City;nodes;1;x', "quoting"), (1, '"7" ;City;nodes;1;x', "quoting"), (1, "7,City,nodes,1,x", "column_count"),
    (2, '1,Person,"{""a"": 1}"', None), (2, "1,Person,", None), (2, '1,Person,""', None), (2, '1,Person,"{""a"": NaN}"', "invalid_value"),
    (2, "1,Person,[1]", "invalid_value"), (2, '1,Person,{}', None), (2, 'x,Person,{}', "invalid_value"), (2, ",Person,{}", "invalid_value"),
    (3, '{"label": "A", "props": {}}', None), (3, ' {"labels": ["A", "B"]} ', None), (3, '{"label": null, "labels": ["A"]}', None),
    (3, '{"label": "A"} x', "bad_json"), (3, '{"label": "A",}', "bad_json"), (3, '{"label": Infinity}', "bad_json"), (3, "", "bad_json"),
    (3, "[]", "invalid_value"), (3, "3", "invalid_value"), (3, '{"label": ""}', "invalid_value"), (3, '{"label": 5}', "invalid_value"),
    (3, '{"label": "A", "labels": [1]}', "invalid_value"), (3, '{"label": "A", "labels": null}', "invalid_value"),
    (3, '{"labels": []}', "invalid_value"), (3, '{"label": "A", "props": null}', "invalid_value"), (3, '{"label": "A", "props": [1]}', "invalid_value"),
    (3, '{"label": "A", "props": {"x": 0831}}', "bad_json"), (3, '{"label": "A", "x": "a\tb"}', "bad_json"), (3, "[" * 5000, "bad_json"),
    (3, '{"label": "A", "props": {"x": ' + "9" * 6000 + "}}", None),
    (4, "7,City,nodes,12,2031-02-03T04:05:06Z", None), (5, "a,b", "unknown_layout"), (9, "a,b", "unknown_layout"),
]


def test_reasons(spark):
    lines = [(f, n + 2, line) for n, (f, line, _) in enumerate(CASES)]
    got = {(r.file_no, r.line_no): r.reason for r in load(spark, lines).collect()}
    assert got == {(f, n + 2): why for n, (f, _, why) in enumerate(CASES)}


def test_headers_are_no_records(spark):
    got = load(spark, [(1, 1, "copy_id;target"), (2, 1, 'broken"'), (3, 1, '{"label": "A"}')]).collect()
    assert [(r.file_no, r.reason) for r in got] == [(3, None)]


def test_values(spark):
    long = "x" * 300_000
    lines = [(1, 2, '7;"a ""b"";\nc";nodes;0012;2031-02-03T04:05:06Z\r'), (2, 2, f'8,{long},"{{""k"": ""v""}}"'), (3, 5, '{"labels": ["", "B"], "props": {"n": 1.50}}')]
    records = load(spark, lines)
    (copy,) = raw_records.copy_outcomes(records).collect()
    assert tuple(copy)[2:] == (7, 'a "b";\nc', "nodes", 12, dt.datetime(2031, 2, 3, 4, 5, 6))
    a, b = sorted(raw_records.node_bodies(records).collect(), key=lambda r: r.file_no)
    assert (a.node_id, a.label, a.props) == (8, long, '{"k": "v"}')
    assert (b.node_id, b.label, b.labels, b.props) == (None, "B", ["", "B"], '{"n":1.50}')


def test_random_records_against_the_csv_module(spark):
    rng = random.Random(5)
    lines, want = [], {}
    for n in range(2, 600):
        text = "".join(rng.choice('ab";\n ,') for _ in range(rng.randrange(0, 9)))
        fields = [str(n), text, "nodes", str(rng.randrange(99)), "2031-02-03T04:05:06Z"]
        if rng.random() < 0.2:
            fields.insert(rng.randrange(5), "more")
        out = io.StringIO()
        csv.writer(out, delimiter=";", lineterminator="").writerow(fields)
        lines.append((1, n, out.getvalue()))
        want[n] = "column_count" if len(fields) == 6 else None if text else "invalid_value"
    got = {r.line_no: (r.reason, r.target) for r in load(spark, lines).collect()}
    assert {n: why for n, (why, _) in got.items()} == want
    for _, n, line in lines:
        if want[n] is None:
            assert got[n][1] == next(csv.reader(io.StringIO(line, newline=""), delimiter=";"))[1]


@pytest.mark.parametrize("text", ["1e5", '"a"', "[1, 2.5, null]", '{"a": {"b": []}}', " true "])
def test_strict_json_accepts(text):
    ok, _ = raw_records.strict_json(text)
    assert ok and json.loads(text) is not NotImplemented


def test_empty_and_repeated(spark):
    assert load(spark, []).count() == 0
    line = (1, 2, "7;City;nodes;1;2031-02-03T04:05:06Z")
    assert load(spark, [line, line]).count() == 2
    assert load(spark, [line], FILES + FILES).count() == 1


def test_rows_without_line_number_are_kept(spark):
    lines = [(1, None, "7;City;nodes;12;2031-02-03T04:05:06Z"), (1, None, "7;City"), (1, 1, "header"), (3, None, "")]
    got = sorted((r.file_no, r.reason or "") for r in load(spark, lines).collect())
    assert got == [(1, ""), (1, "column_count"), (3, "bad_json")]
