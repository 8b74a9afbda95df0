"""tallyspark: sales and inventory analytics for a retail back office, on Spark.

Every operator is a function ``DataFrame(s) + explicit parameters -> DataFrame``
written with built-in Spark SQL functions, so Catalyst can prune columns, push
filters into the Parquet scan and choose join strategies by measured size.
"""

from tallyspark.periods import period_range, report_period  # noqa: F401

__all__ = ["period_range", "report_period"]
