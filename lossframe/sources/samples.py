"""The sample loss run and sample mapping offered for download.

Fixed values of the reference's sample file (three claims), used as a
test fixture and as a template for users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lossframe.operators.mapping import identity_mapping, mapping_to_json

# The sample loss run (as CSV text cells).
SAMPLE_HEADER = ["run_id", "tenant_id", "claim_id", "loss_date", "report_date", "paid", "incurred",
                 "outstanding", "currency", "policy_number", "status", "claimant"]
SAMPLE_ROWS = [
    (None, "", "C-1001", "2023-01-05", "2023-01-10", "1200", "1500", "300", "AUD", "POL123", "Open", "Jane Doe"),
    (None, "", "C-1002", "2023-03-18", "2023-03-20", "0", "500", "500", "AUD", "POL456", "Closed",
     "Acme Pty Ltd"),
    (None, "", "C-1003", "2023-06-02", "2023-06-06", "7500", "9000", "1500", "AUD", "POL789", "Open",
     "John Smith"),
]


def sample_loss_run(spark: SparkSession, with_line: bool = True) -> DataFrame:
    """The sample rows as an all-text raw frame (``_line`` = file line order)."""
    cols = SAMPLE_HEADER + (["_line"] if with_line else [])
    rows = [r + ((i + 1,) if with_line else ()) for i, r in enumerate(SAMPLE_ROWS)]
    schema = ", ".join(f"`{c}` string" for c in SAMPLE_HEADER) + (", _line int" if with_line else "")
    return spark.createDataFrame(rows, schema).select(*cols)


def sample_mapping_json() -> str:
    return mapping_to_json(identity_mapping())
