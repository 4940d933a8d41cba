import pytest

from netloom.operators.parse_errors import parse_lines

LINES = "line_id long, file_id long, line_no int, raw_line string, cells string, reason string"
FILES = "file_id long, layer string, sep_char string, has_header boolean, raw string"

CASES = [
    ("1;2;3.5", None), ('"1";" 2 ";+.5e1', None), ("1;2;5.", None), ("  7 ;8;-0\r", None), ("4294967295;0;3.4028234e38", None),
    ("1;2", "column count"), ("1;2;3;4", "column count"), ("1;2;3;", "column count"), ("1;2;", "invalid value"), ("# note", "column count"),
    ('1;"2;3', "quoting"), ('1;2";3', "quoting"), ('"1"x;2;3', "quoting"), ('1; "2";3', "quoting"), ('""1"";2;3', "quoting"),
    ('1;"2;3";4', "invalid value"), ('1;"2""3";4', "invalid value"), ('"";2;3', "invalid value"), ("1;2;1e39", "invalid value"), ("1;2;1e999", "invalid value"),
    ("4294967296;1;1", "invalid value"), ("99999999999999999999;1;1", "invalid value"), ("0000000000000000000012;1;1", None), ("-1;2;3", "invalid value"), ("1;2;nan", "invalid value"),
    ("1;2;1_0", "invalid value"), ("٣;2;1", "invalid value"), ("1;2;.", "invalid value"), ("1;2;1e", "invalid value"), ("1;2;3\n", "invalid value"), ("1;2;3\r\r", "invalid value"),
    ("1; 2;3", "invalid value"), ('"1";"2";"\u00013"', "invalid value"), ("9" * 200_000 + ";1;1", "invalid value"), ('"' + '""' * 50_000 + '";1;1', "invalid value"),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "a", ";", False, "x"), (2, "b", "\t", True, "x"), (2, "b", "\t", True, "x"), (3, "c", None, False, None), (4, "d", " ", None, None), (5, "e", "|", True, None), (None, "n", ";", True, None), (6, "f", "\\", False, None), (7, "g", ".", False, None)]
    return spark.createDataFrame(rows, FILES)


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_cases(spark, files, broadcast_rows):
    lines = spark.createDataFrame([(i, 1, i + 1, raw, "c", "r") for i, (raw, _) in enumerate(CASES)], LINES)
    got = {r["line_id"]: r["reason"] for r in parse_lines(lines, files, broadcast_rows=broadcast_rows).collect()}
    assert [(CASES[i][0][:30], got[i]) for i in range(len(CASES))] == [(c[:30], r) for c, r in CASES]


def test_files_and_special_lines(spark, files):
    data = [
        (1, 2, 1, "from\tto\tvalue"), (2, 2, 2, "1\t2\t3"), (3, 2, 3, "  "), (4, 2, 4, "\r"), (5, 2, 5, None), (6, 3, 1, "1;2;3"), (7, None, 1, "1;2;3"),
        (8, 99, 1, "1;2;3"), (9, 4, 1, "1 2 3"), (10, 4, 2, '" 1 " 2 3'), (11, 5, None, "1|2|3"), (12, 5, 2, "1|2|3"), (12, 5, 2, "1|2|3"), (13, 6, 1, "1\\2\\3"), (14, 7, 1, "1.2.3"), (15, 1, 1, ""),
    ]
    got = parse_lines(spark.createDataFrame([(*r, None, None) for r in data], LINES), files).collect()
    assert sorted((r["line_id"], r["reason"]) for r in got if r["reason"]) == [(6, "separator"), (7, "file"), (8, "file")]
    fine = sorted((r["line_id"], r["from"], r["to"], r["value"]) for r in got if not r["reason"])
    assert fine == [(k, 1, 2, 3.0) for k in (2, 9, 10, 11, 12, 12, 13, 14)]


def test_empty(spark, files):
    none = spark.createDataFrame([], LINES)
    assert parse_lines(none, files).count() == 0 and parse_lines(none, files.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_lines_without_id_and_files_given_twice(spark, broadcast_rows):
    files = spark.createDataFrame(
        [(1, "late", ",", False, "2024-02-01"), (1, "early", ";", False, "2024-01-01"), (1, "undated", "|", False, None), (2, "x", "|", True, None)],
        "file_id long, layer string, sep_char string, has_header boolean, delivered_at string",
    ).selectExpr("file_id", "layer", "sep_char", "has_header", "cast(delivered_at as timestamp) as delivered_at")
    data = [(None, 1, 1, "1;2;x"), (None, 1, 2, "1;2;3"), (None, 2, 1, "a|b|c"), (None, 2, 2, "-|2|3"), (None, 1, 3, "1;2;x"), (None, 1, 4, '"1";"2";x')]
    got = parse_lines(spark.createDataFrame([(*r, None, None) for r in data], LINES), files, broadcast_rows=broadcast_rows).collect()
    bad = sorted((r["layer"], r["line_no"], r["reason"], r["detail"]) for r in got if r["reason"])
    assert bad == [*[("early", k, "invalid value", "value: not a number") for k in (1, 3, 4)], ("x", 2, "invalid value", "from: not digits")]
    assert [(r["line_no"], r["from"], r["to"], r["value"]) for r in got if not r["reason"]] == [(2, 1, 2, 3.0)]
