from pyspark.sql import functions as F

from deskloom import fixed
from deskloom.operators import metrics, validation

GOOD = {
    "issue": "i", "subject": "s", "company": "c", "response": "r", "product_area": "p", "status": "replied",
    "request_type": "bug", "justification": "j", "confidence_score": "0.5", "source_documents": "", "risk_level": "low",
    "pii_detected": "true", "language": "en", "actions_taken": "[]",
}
FAULTS = [
    ({}, []),
    ({"status": " Replied "}, []),
    ({"status": "open"}, [("error", "status")]),
    ({"request_type": ""}, [("error", "request_type")]),
    ({"response": " "}, [("warning", "response")]),
    ({"confidence_score": ""}, [("warning", "confidence_score")]),
    ({"confidence_score": "high"}, [("error", "confidence_score")]),
    ({"confidence_score": "1.01"}, [("error", "confidence_score")]),
    ({"confidence_score": "NaN"}, [("error", "confidence_score")]),
    ({"risk_level": "severe"}, [("error", "risk_level")]),
    ({"risk_level": None}, [("warning", "risk_level")]),
    ({"pii_detected": "yes"}, [("error", "pii_detected")]),
    ({"pii_detected": ""}, [("warning", "pii_detected")]),
    ({"language": ""}, [("warning", "language")]),
    ({"language": "english"}, [("warning", "language")]),
    ({"actions_taken": ""}, [("warning", "actions_taken")]),
    ({"actions_taken": "[1"}, [("error", "actions_taken")]),
    ({"actions_taken": "{}"}, [("error", "actions_taken")]),
    ({"actions_taken": "[{}]"}, []),
]


def table(spark, rows):
    schema = "ticket_id bigint, " + ", ".join(f"{c} string" for c in GOOD)
    return spark.createDataFrame([(n, *{**GOOD, **r}.values()) for n, r in enumerate(rows)], schema)


def test_every_rule(spark):
    found = validation.row_findings(table(spark, [r for r, _ in FAULTS]), "ticket_id").collect()
    for n, (_, expected) in enumerate(FAULTS):
        assert [(f.severity, f.check) for f in found if f.row_no == n] == expected, FAULTS[n]


def test_clean_table_passes(spark):
    df = table(spark, [{}] * 3)
    assert validation.validate(df, df).count() == 0 and validation.passes(validation.validate(df, df))


def test_headers_and_counts(spark):
    df = table(spark, [{}] * 3).drop("status").withColumn("more", F.lit(1))
    found = {(f.severity, f.check): f.message for f in validation.validate(table(spark, [{}] * 4), df).collect()}
    assert found["error", "headers"] == "the table lacks status"
    assert found["warning", "headers"] == "no one reads more"
    assert found["error", "row_count"] == "3 rows for 4 tickets"
    assert ("error", "status") in found


def test_report_caps(spark):
    df = table(spark, [{"status": "open", "response": ""}] * 50)
    found = validation.row_findings(df, "ticket_id")
    assert not validation.passes(found)
    assert {r.severity: r.n for r in validation.report(found).groupBy("severity").agg(F.count("*").alias("n")).collect()} == {
        "error": fixed.REPORT_ERRORS, "warning": fixed.REPORT_WARNINGS,
    }


def test_f1(spark):
    rows = [("replied", "replied")] * 3 + [("replied", "Escalated")] + [("escalated", "escalated ")] * 2
    got = {r["class"]: r for r in metrics.routing_f1(spark.createDataFrame(rows, "status string, gold_status string")).collect()}
    assert (got["replied"].tp, got["replied"].fp, got["replied"].fn) == (3, 1, 0)
    assert abs(got["escalated"].f1 - 0.8) < 1e-12


def test_brier_and_flat(spark):
    got = metrics.brier(spark.createDataFrame([(0.8, True), (0.8, False)], "confidence double, correct boolean")).first()
    assert abs(got.brier - (0.04 + 0.64) / 2) < 1e-12 and got.flat and got.spread == 0.0


def test_calibration_last_bin_holds_one(spark):
    got = metrics.calibration(spark.createDataFrame([(1.0, True), (0.95, True), (0.05, False)], "confidence double, correct boolean"))
    assert {r.bin: r.n for r in got.collect()} == {9: 2, 0: 1}


def test_citations(spark):
    rows = spark.createDataFrame([(1, "a.md|b.md"), (2, " b.md |"), (3, "")], "ticket_id int, source_documents string")
    corpus = spark.createDataFrame([("a.md",)], "doc_path string")
    got = metrics.missing_citations(metrics.citations(rows), corpus).collect()
    assert [(r.doc_path, r.n_citations) for r in got] == [("b.md", 2)]


def test_pii_echo(spark):
    rows = spark.createDataFrame([("mail a@b.co and 10.0.0.1", "we wrote to a@b.co"), ("none", "none")], "t string, r string")
    assert [r.echoed for r in metrics.pii_echo(rows, "t", "r").collect()] == [["a@b.co"], []]


def test_run_diff(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    assert metrics.run_diff(a, a).count() == 0
    assert {(r.k, r.v, r.surplus) for r in metrics.run_diff(a, b).collect()} == {(1, "x", 1), (3, "z", -1)}


def test_run_diff_moves_rows_around_the_differences_only(spark, monkeypatch):
    a = spark.range(20_000).select("id", F.col("id").cast("string").alias("v"), (F.col("id") % 9).alias("o.dd"))
    b = a.where("id != 77").withColumn("v", F.when(F.col("id") == 5000, "new").otherwise(F.col("v")))
    for leaf, bits in ((100_000, 16), (100, 4), (1, 4), (0, 16)):
        monkeypatch.setattr(metrics, "LEAF_ROWS", leaf)
        monkeypatch.setattr(metrics, "DIGEST_BITS", bits)
        got = {(r["id"], r["v"], r["surplus"]) for r in metrics.run_diff(a, b).collect()}
        assert got == {(77, "77", 1), (5000, "5000", 1), (5000, "new", -1)}
        if leaf == 1:  # four levels of 16 buckets
            assert metrics.differing_rows(a, b).count() < 20
    assert metrics.differing_rows(a, a.repartition(3)).count() == 0


def test_run_diff_of_signed_zeros_and_repeated_rows(spark):
    a = spark.createDataFrame([(0.0, "x")] * 3 + [(float("nan"), None)], "x double, y string")
    b = spark.createDataFrame([(-0.0, "x")] * 2 + [(float("nan"), None)], "x double, y string")
    assert [tuple(r) for r in metrics.run_diff(a, b).collect()] == [(0.0, "x", 1)]


def test_tally(spark):
    cases = spark.createDataFrame([("g", True), ("g", False), ("h", True)], "family string, ok boolean")
    assert tuple(metrics.tally(cases).first()) == (2, 1)


TOOLS = [
    ("issue_refund", "d", ("object", {"transaction_id": ("string", ""), "amount": ("number", "")}, ["transaction_id", "amount"])),
    ("verify_identity", "d", ("object", {"target": ("string", "Who: 'owner', 'agent'")}, ["target"])),
]


def test_tool_conformance(spark):
    from deskloom.sources.corpus import TOOLS as schema

    actions = [
        '[{"action":"issue_refund","parameters":{"transaction_id":"t","amount":5}}]',
        '[{"action":"verify_identity","parameters":{"target":"u"}},{"action":"issue_refund","parameters":{"transaction_id":7,"amount":"5","x":1}}]',
        '[{"action":"fly"}]', "[]", "oops",
    ]
    rows = spark.createDataFrame(list(enumerate(actions)), "ticket_id int, actions_taken string")
    got = metrics.tool_conformance(rows, spark.createDataFrame(TOOLS, schema)).orderBy("ticket_id", "position").collect()
    assert [(r.ticket_id, r.action, r.known, r.unverified) for r in got] == [
        (0, "issue_refund", True, True), (1, "verify_identity", True, False), (1, "issue_refund", True, False), (2, "fly", False, False),
    ]
    assert [r.wrong_value for r in got] == [[], ["target"], [], []]
    assert got[2].wrong_type == ["amount", "transaction_id"] and got[2].unknown == ["x"] and got[0].wrong_type == []
