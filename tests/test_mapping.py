"""Mapping of schemas: names, application, issues, the standard format."""

from tidewright.functions import headers as H
from tidewright.plans.mapping import apply_mapping, compliance, infer, issue_summary, standard_name, to_standard, union_mapped, words_of

RAW = ["Customer Number", "Customer Segment", "Company Name", "Address Line 1", "Address Line 2", "City", "State", "Zip Code", "Email", "Phone Number", "Job Title", "First Name", "Last Name", "Sales Rep", "SQL", "Lead Source"]


def test_words():
    assert [words_of(x) for x in ("  Email Address  ", "Email_Address", "E-Mail", "Company  Name", "Sls#", "zip+4")] == ["email address", "email address", "e mail", "company name", "sls#", "zip 4"]


def test_inference():
    found = infer(RAW)
    want = {"Cust": "Customer Number", "Seg": "Customer Segment", "Company": "Company Name", "Address1": "Address Line 1", "Address2": "Address Line 2", "City": "City", "State": "State", "Zip": "Zip Code", "Email Address": "Email", "Telephone": "Phone Number", "Title": "Job Title", "Rep Name": "Sales Rep", "SQL": "SQL", "Sugar Lead Source": "Lead Source", "KeyCode": None, "Seqno": None}
    for shared in (False, True):
        found = infer(RAW, shared=shared)
        assert {t: found.columns[t] for t in want} == want
        assert (found.contact, found.first, found.last, found.columns["Contact"]) == ("build_first_last", "First Name", "Last Name", None)
    assert list(found.columns) == list(H.MAIL) and len(found.columns) == 24
    assert infer(["Contact", "Email", "Company"]).contact == "use_contact"
    assert infer(["Nothing", "Here"]).contact == "blank" and infer([]).columns["Company"] is None


def test_one_source_for_one_target():
    """An address without a number is like both lines; only the better gets it, unless sources may be shared."""
    assert infer(["Address"]).columns["Address1"] == "Address" and infer(["Address"]).columns["Address2"] is None
    assert infer(["Address"], shared=True).columns["Address2"] == "Address"
    rivals = infer(["Email", "Email Address", "Phone"])
    assert [c for c in rivals.conflicts if c["target"] == "Email Address"][0]["candidates"] == ["Email", "Email Address"]
    assert rivals.confidence["Email Address"] == "high" and rivals.confidence["KeyCode"] == "low"


def test_application(spark):
    rows = [("C001", "ACME", "a@a.com", "Boston", "MA", "02101", "Alice", " Smith "), ("C002", None, "b(at)b", "NY", "XX", "1", None, "Jones"), ("C003", " ", None, None, "Ohio", "43210-1234", "", None)]
    df = spark.createDataFrame(rows, "`Customer Number` string, `Company Name` string, Email string, City string, State string, `Zip Code` string, `First Name` string, `Last Name` string").withColumn("a.b", Fnone())
    done = apply_mapping(df, infer(df.columns), keys=["Customer Number"])
    assert done.rows.columns == ["Customer Number", *H.MAIL]
    got = {r["Cust"]: r for r in done.rows.collect()}
    assert [got[c]["Contact"] for c in ("C001", "C002", "C003")] == ["Alice Smith", "Jones", ""]
    assert {r["KeyCode"] for r in got.values()} == {""} and got["C003"]["Company"] == " " and got["C002"]["Company"] is None
    issues = {(r["Customer Number"], r["target"], r["code"]) for r in done.issues.collect()}
    assert issues == {("C002", "Company", "BLANK_VALUE"), ("C003", "Company", "BLANK_VALUE"), ("C003", "City", "BLANK_VALUE"), ("C003", "Contact", "BLANK_VALUE"), ("C002", "Email Address", "INVALID_EMAIL"), ("C003", "Email Address", "BLANK_VALUE"), ("C002", "State", "UNKNOWN_STATE"), ("C002", "Zip", "INVALID_ZIP")}
    assert done.counts["rows"] == 3 and done.counts["BLANK_VALUE: Company"] == 2 and done.counts["INVALID_EMAIL: Email Address"] == 1
    assert {(r["target"], r["code"]): r["rows"] for r in issue_summary(done).collect()} == {tuple(reversed(k.split(": "))): n for k, n in done.counts.items() if k != "rows" and n}
    missing = {n["target"] for n in done.notes if n["code"] == "MISSING_REQUIRED_FIELD"}
    assert missing == {"Seg", "Sls#", "Rep Name", "Address1", "Address2", "Title", "Telephone", "SQL", "Sugar Lead Source"} and not missing & set(H.MAIL_BLANK)
    assert infer(df.columns).dropped(df.columns) == ["a.b"]
    done.drop()
    twice = apply_mapping(df.select("Email", "City"), infer(["Email", "City"]), keys=[])
    assert twice.rows.columns == list(H.MAIL) and twice.rows.count() == 3
    assert apply_mapping(df.limit(0), infer(df.columns)).counts["rows"] == 0
    shared = apply_mapping(df.withColumnRenamed("City", "Address"), infer(["Address"], shared=True))
    assert {n["target"] for n in shared.notes if n["code"] == "DUPLICATE_SOURCE_USED"} == {"Address2"}


def Fnone():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_letters(spark):
    df = spark.createDataFrame([("Ann", "Acme", "1 Main", "Troy", "OH", "45373"), ("Bob", "B", "2 Main", None, "OH", None)], "Name string, Company string, Street string, Town string, St string, Zipcode string")
    mapping = infer(df.columns, letter=True)
    assert mapping.places == {"City": "Town", "State": "St", "Zip": "Zipcode"}
    done = apply_mapping(df, mapping)
    assert done.rows.columns == list(H.LETTER)
    assert {r["City, State, Zip"] for r in done.rows.collect()} == {"Troy, OH 45373", "OH"}
    both = union_mapped({"a": df, "b": df.withColumnRenamed("Company", "Firm")}, letter=True)
    assert both.count() == 4 and both.columns == ["Source_File", *H.LETTER]


def test_standard_format(spark):
    assert standard_name("Company")[:3] == ("Company", "keep", 1.0)
    assert standard_name("customer id")[:3] == ("Customer", "rename", 0.98)
    assert standard_name("Address 1")[:2] == ("Address 1", "rename") and standard_name("  ")[1] == "remove"
    assert standard_name("ZoomInfo Company Rank")[1:2] == ("remove",) and standard_name("Fax Number")[1] == "remove" and standard_name("Legacy_Key")[3] == "not wanted: deprecated"
    assert standard_name("Favourite colour")[1:] == ("review", 0.0, "unknown")
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], ["Job_Title", "Match_Score", "Other", "Cust#", "Customer_ID", "Emial Address"])
    out = to_standard(df)
    assert out.columns == ["Customer", "Title", "Other", "Customer_ID", "Emial Address"]
    assert to_standard(df, every=True).columns == ["Customer", "Title", "Email", "Other", "Customer_ID"]
    report = compliance(df.columns)
    assert report["found"] == ["Customer", "Email", "Title"] and "Company" in report["missing"] and report["actions"]["remove"] == 1
