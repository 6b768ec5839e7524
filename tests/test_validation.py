"""Results of validations: what is left, appended chunks, every occurrence."""

import pytest

from tidewright.plans.validation import append_chunk, occurrences, pending, read_results, status_counts, validated

RESULT = "Email string, status string, validated_at timestamp"


def test_a_resumed_validation(spark, tmp_path):
    people = spark.createDataFrame([(i, f" User{i % 7}@X.com ", "n") for i in range(20)] + [(20, "bad", "n"), (21, None, "n"), (22, "  ", "n")], "id int, mail string, other string")
    found = occurrences({"a": people, "b": people.limit(0), "c": people}, {"a": "mail", "b": "mail", "c": "absent"}, ["id"])
    assert found.count() == 21
    nothing = spark.createDataFrame([], RESULT)
    first = {r["Email"]: (r["occurrences"], r["chunk"]) for r in pending(found, nothing, chunks=3).collect()}
    assert {e: n for e, (n, _) in first.items()} == {f"user{i}@x.com": len(range(i, 20, 7)) for i in range(7)}
    done = [e for e, (_, c) in first.items() if c == first["user0@x.com"][1]]
    answer = lambda status, day: spark.sql("select " + ", ".join(["explode(array(" + ", ".join(f"'{e.upper()}'" for e in done) + ")) as Email", f"'{status}' as status", f"timestamp'2024-01-0{day} 00:00:00' as validated_at"]))
    path = str(tmp_path / "results")
    append_chunk(answer("risky", 1), path, "first", 0)
    append_chunk(answer("risky", 1), path, "first", 0)
    known = read_results(spark, path)
    assert known.count() == len(done)  # a chunk that comes twice counts once
    assert {r["Email"] for r in pending(found, known).collect()} == set(first) - set(done)
    append_chunk(answer("deliverable", 2), path, "second", 0)
    state = {r["id"]: r for r in validated(found, read_results(spark, path)).collect()}
    assert len(state) == 21 and state[20]["Email_status"] == "invalid_format" and not state[20]["Email_Validated"]
    for i in range(20):
        own = f"user{i % 7}@x.com" in done
        assert (state[i]["Email_status"], state[i]["Email_Validated"], state[i]["Email_error"]) == (("deliverable", True, None) if own else ("unknown", False, "Not validated"))
    counts = status_counts(validated(found, read_results(spark, path))).first()
    n = sum(1 for i in range(20) if f"user{i % 7}@x.com" in done)
    assert tuple(counts) == (21, 8, n, 0, 0, 21 - n, 0)
    with pytest.raises(ValueError):
        occurrences({"a": people}, {}, ["id"])


def test_empty(spark):
    none = spark.createDataFrame([], "id int, mail string")
    found = occurrences({"a": none}, {"a": "mail"}, ["id"])
    assert tuple(status_counts(validated(found, spark.createDataFrame([], RESULT))).first()) == (0, 0, 0, 0, 0, 0, 0)
