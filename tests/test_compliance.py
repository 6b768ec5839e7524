"""Issues by kinds of columns, with examples; formats."""

from tidewright.functions import headers as H
from tidewright.operators.base import REGISTRY
from tidewright.plans.compliance import RULES, column_issues, format_findings, vendor_export


def test_issues_name_rows(spark):
    rows = [(i, f"u{i}@x.co" if i % 4 else f"bad{i}", "5551234567" if i % 3 else "12", ["43210", "4321", None, "43210-1234"][i % 4], ["OH", "ak", None][i % 3], ["ACME", "Acme", None][i % 3], "1 P.O. Box 2" if i == 7 else "1 Oak St") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, email string, phone string, zip string, state string, company string, street string")
    found = {(r["column"], r["issue"]): r for r in column_issues(df, "id").collect()}
    want = {
        ("email", "invalid_email"): [i for i in range(60) if i % 4 == 0], ("phone", "not_10_digits"): [i for i in range(60) if i % 3 == 0], ("zip", "invalid_zip"): [i for i in range(60) if i % 4 == 1],
        ("state", "excluded_state"): [i for i in range(60) if i % 3 == 1], ("company", "mixed_case"): [i for i in range(60) if i % 3 == 1], ("street", "po_box"): [7],
    }
    assert set(found) == set(want)
    for k, ids in want.items():
        r = found[k]
        assert r["rows"] == len(ids) and set(r["examples"]) <= set(map(str, ids)) and 1 <= len(r["examples"]) <= 3
    assert found["company", "mixed_case"]["held"] == 40
    few = df.withColumn("company", df.company.substr(1, 0)).filter("id % 3 = 0")
    assert column_issues(df.limit(0), "id").collect() == [] and column_issues(few.select("id", "state"), "id").collect() == []
    assert {r["issue"] for r in column_issues(df, "id", {"street": "email"}, RULES[:1]).collect()} == {"invalid_email"}


def test_shares(spark):
    """Mixed case is a finding above three tenths of the values only."""
    make = lambda mixed: spark.createDataFrame([(i, "Acme" if i < mixed else "ACME") for i in range(10)], "id int, company string")
    assert column_issues(make(3), "id").collect() == [] and column_issues(make(4), "id").first()["rows"] == 4


def test_keys_are_not_judged_by_contents(spark):
    """Keys of five digits aren't zip codes; kinds that are given or told by the name hold."""
    df = spark.createDataFrame([(i, str(i)) for i in [*range(10000, 10009), 7]], "contact_id int, code string")
    assert [r["column"] for r in column_issues(df, "contact_id").collect()] == ["code"]
    assert [r["rows"] for r in column_issues(df.withColumnRenamed("contact_id", "zip").select("zip"), "zip").collect()] == [1]
    assert [r["column"] for r in column_issues(df, "contact_id", {"contact_id": "zip"}).collect()] == ["contact_id"]


def test_formats():
    found = {f["finding"]: f for f in format_findings(["Customer#", "Match_Score", "Email", "Colour", "Company"])}
    assert found["unwanted_columns"]["columns"] == ["Match_Score"] and found["columns_to_rename"]["columns"] == ["Customer#"] and found["columns_to_review"]["columns"] == ["Colour"]
    assert found["missing_columns"]["columns"] == ["Address 1", "City", "State", "Zip", "Phone"] and round(found["compliance"]["percent"], 1) == 21.4
    assert all(s["operation_id"] in REGISTRY for f in found.values() for s in f["steps"])
    assert format_findings(list(H.STANDARD)) == [] or {f["finding"] for f in format_findings(list(H.STANDARD))} <= {"columns_to_rename"}
    assert vendor_export(H.VENDOR_IDS[:1]) == (None, 0.0) and vendor_export(H.VENDOR_IDS[:2]) == ("vendor_contacts", 0.7)
    assert vendor_export(H.VENDOR_IDS + H.VENDOR_CONTACTS) == ("vendor_contacts", 0.92)
