import json

import pytest

from auditmill.operators import findings, replies

CHUNKS = [("c1", "a.py", 10, "l10\nl11\nl12"), ("c2", "b.py", 1, "x")]


def item(**more):
    return {"cwe_id": "CWE-89", "severity": "high", "title": "t", "description": "d", "line_start": 11, "line_end": 12,
            "recommendation": "r", "confidence": 0.9, **more}


def without(name):
    return {k: v for k, v in item().items() if k != name}


def reply(*items):
    return json.dumps({"findings": list(items)})


@pytest.fixture()
def parse(spark):
    def run(*raws):
        given = spark.createDataFrame([("c1", 1, raw) for raw in raws], "chunk_id string, attempt int, raw string")
        chunks = spark.createDataFrame(CHUNKS, "chunk_id string, file_path string, line_start int, code string")
        return replies.parse_replies(given, chunks).orderBy("item_no").collect()

    return run


def test_a_full_item(parse):
    row = parse(reply(item()))[0]
    assert row["reason"] is None and row["code_snippet"] == "l11\nl12" and row["file_path"] == "a.py"
    assert (row["line_start"], row["line_end"], row["confidence"], row["severity"]) == (11, 12, 0.9, "high")


@pytest.mark.parametrize("raw", ["", "NOT JSON", "{", "[]", "1", "null", '{"findings": {}}', '{"findings": null}', '{"other": []}',
                                 '{"findings": []}', '[{"cwe_id": "x"}]'])
def test_replies_without_items(parse, raw):
    assert parse(raw) == []


def test_defaults(parse):
    row = parse(reply({"cwe_id": "CWE-1"}))[0]
    assert row["reason"] is None
    assert (row["severity"], row["title"], row["line_start"], row["line_end"], row["confidence"]) == ("medium", "", 10, 10, 0.5)
    assert row["code_snippet"] == "l10"
    assert parse(reply({"cwe_id": "CWE-1", "line_start": 12}))[0]["line_end"] == 12


@pytest.mark.parametrize("value,want", [(11, 11), ("11", 11), (" 11 ", 11), (11.7, 11), (-11.7, -11), (True, 1), ("-3", -3)])
def test_integers_in_other_clothes(parse, value, want):
    row = parse(reply(item(line_start=value)))[0]
    assert row["reason"] is None and row["line_start"] == want


@pytest.mark.parametrize("value,want", [(1, 1.0), ("0.25", 0.25), (" 1e-1 ", 0.1), (True, 1.0), (0, 0.0)])
def test_numbers_in_other_clothes(parse, value, want):
    row = parse(reply(item(confidence=value)))[0]
    assert row["reason"] is None and row["confidence"] == want


@pytest.mark.parametrize("bad,reason", [
    (without("cwe_id"), "missing_id"), (item(cwe_id=None), "bad_text"), (item(cwe_id=89), "bad_text"),
    (item(severity="urgent"), "bad_severity"), (item(severity=None), "bad_severity"), (item(severity=3), "bad_severity"),
    (item(confidence=1.5), "bad_confidence"), (item(confidence=-0.1), "bad_confidence"), (item(confidence="x"), "bad_confidence"),
    (item(confidence="0.9d"), "bad_confidence"), (item(confidence=None), "bad_confidence"), (item(confidence="NaN"), "bad_confidence"),
    (item(line_start=None), "bad_line"), (item(line_start="11.7"), "bad_line"), (item(line_end=[1]), "bad_line"),
    (item(line_start="x"), "bad_line"), (item(title=None), "bad_text"), (item(description=5), "bad_text"),
    (item(recommendation=["a"]), "bad_text"), ("text", "not_an_object"), (7, "not_an_object"), (None, "not_an_object"),
])
def test_a_bad_item_costs_only_itself(parse, bad, reason):
    rows = parse(reply(bad, item(severity="HIGH")))
    assert [r["reason"] for r in rows] == [reason, None]
    assert rows[1]["severity"] == "high" and rows[0]["code_snippet"] is None


def test_second_attempt_counts_only_without_a_first(spark):
    rows = [("a", 1, "f1"), ("a", 2, "f2"), ("b", 2, "f3"), ("b", 2, "f4")]
    found = spark.createDataFrame(rows, "chunk_id string, attempt int, f string")
    assert {r["f"] for r in replies.first_attempt_with_findings(found).collect()} == {"f1", "f3", "f4"}


SCHEMA = "cwe_id string, severity string, line_start bigint, line_end bigint, confidence double, file_path string, seq int"
ROWS = [
    ("CWE-1", "HIGH", 1, 2, 0.4, "f", 1),   # under the threshold, so the next one is the first
    ("CWE-1", "low", 1, 2, 0.5, "f", 2),
    ("CWE-1", "high", 1, 2, 0.9, "f", 3),
    ("CWE-1", "high", 1, 3, 0.9, "f", 4),
    ("CWE-2", "high", 5, 4, 0.9, "f", 5),
    ("CWE-2", "high", 0, 4, 0.9, "f", 6),
    ("CWE-9", "high", 1, 4, 0.9, "f", 7),
    ("CWE-2", "Info", 4, 4, float("nan"), "f", 8),
    ("CWE-2", "Info", 4, 4, 1.0, "g", 9),
]


def test_validation(spark):
    raw = spark.createDataFrame(ROWS, SCHEMA)
    ids = spark.createDataFrame([("CWE-1",), ("CWE-2",), ("CWE-2",)], "cwe_id string")
    valid = findings.validate(raw, ids, ["seq"]).orderBy("seq").collect()
    # Spark orders NaN above all numbers; the schema check rejects it before this step.
    assert [(r["seq"], r["severity"]) for r in valid] == [(2, "low"), (4, "high"), (8, "info"), (9, "info")]
    assert [r["seq"] for r in findings.validate(raw, ids, ["seq"], 0.95).orderBy("seq").collect()] == [8, 9]
    checked = findings.check(raw, ids)
    assert {r["seq"]: r["reason"] for r in checked.collect()} == {
        1: "low_confidence", 2: None, 3: None, 4: None, 5: "bad_lines", 6: "bad_lines", 7: "unknown_id", 8: None, 9: None}
    assert {r["reason"]: r["n"] for r in findings.reject_counts(checked).collect()} == {"low_confidence": 1, "bad_lines": 2, "unknown_id": 1}
    assert [r["seq"] for r in findings.unknown_ids(raw, ids).collect()] == [7]


def test_schema_bounds(values):
    rows = [("HIGH", 0.0), ("info", 1.0), ("urgent", 0.5), ("low", 1.5), ("low", float("nan")), ("low", -0.1)]
    got = values(rows, "s string, c double", lambda c: findings.well_formed(c("s"), c("c")))
    assert got == [True, True, False, False, False, False]


def test_repeats_are_dropped_before_the_shuffle(spark):
    raw = spark.createDataFrame(ROWS, SCHEMA)
    plan = findings.keep_first(raw, findings.FINDING_KEY, ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
