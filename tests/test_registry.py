"""The registry of operations as plain values."""

import json

from tidewright.operators.base import categories, described
from tidewright.plans.workflow import operations


def test_described():
    every = described()
    assert [o["operation_id"] for o in every] == operations() and sum(categories().values()) == len(every)
    assert json.loads(json.dumps(every)) == every
    trim = next(o for o in every if o["operation_id"] == "text_trim")
    assert trim["parameters"]["columns"] == {"required": "list"}


def test_older_names_of_steps():
    from tidewright.plans.workflow import step_id

    want = {"UppercaseOperation": "text_uppercase", "text uppercase": "text_uppercase", "Trim": "text_trim", "FillMissingOperation": "clean_fill_missing", "text_title_case": "text_title_case", "Remove Duplicates": "data_remove_duplicates", "NothingSuch": "NothingSuch"}
    for given, id in want.items():
        for field in ("class", "name", "operation_id"):
            assert step_id({field: given}) == id
    assert step_id({}) is None
