"""lossframe: claims loss-run / bordereaux data quality on Spark.

Every operator takes and returns DataFrames and is written with built-in
Spark SQL expressions, so Catalyst can push filters, prune columns and
fuse the row-local work into whole-stage codegen.
"""

__version__ = "0.2.0"

from lossframe.session import checkpoint_dir, get_spark  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir"]
