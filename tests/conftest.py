import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("lossframe-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # tests have no cluster-provided checkpoint folder: use a private one
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lossframe-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample_std(spark):
    """The 3-row sample loss run, standardised with the identity mapping, numbered."""
    from lossframe.operators.mapping import identity_mapping
    from lossframe.operators.numbering import number_rows
    from lossframe.operators.standardize import standardize
    from lossframe.sources.samples import sample_loss_run

    raw = sample_loss_run(spark)
    std = standardize(raw, identity_mapping(), source_file="sample_loss_run.csv", tenant_id="t1",
                      run_id="r1", keep=["_line"])
    return number_rows(std, ["_line"]).drop("_line")
