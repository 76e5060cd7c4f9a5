"""What the findings of the fourth round named: each held by a small case that failed before."""

import pandas as pd

from fieldwright.plans import catalogue
from tests.test_findings_r03 import both, plan_of


def test_form_operations_of_names_and_long_keys(spark, tmp_path):
    """names and segments were not among the columns read; keys of which a year of five digits follows gave another date than the SQL."""
    keys = [0, 1, 2, 899_999, 2_932_896, 2_932_897, 5_399_999]
    rows = pd.DataFrame({"c_custkey": keys, "c_name": [f"Customer#{k:09}" for k in keys], "c_nationkey": range(7), "c_acctbal": 1.0, "c_mktsegment": ["BUILDING", "MACHINERY", "FURNITURE"] * 2 + ["AUTOMOBILE"]})
    rows.astype({"c_nationkey": "int32"}).to_parquet(f"{tmp_path}/customer.parquet")
    mine, theirs = both(spark, tmp_path, "document_form_operations", ("customer",))
    assert mine == theirs and len(mine) == 18
    assert (5_399_999, "Line19", "text", "09/12/16754") in mine and (0, "Line1", "text", "Customer#000000000") in mine and (1, "Line1", "text", "MACHINERY") in mine
    assert "REPARTITION_BY_NUM" in plan_of(spark, catalogue.queries()["document_form_operations"](spark, str(tmp_path)))
