"""quarry: Spark-native profiling, validation, feature preparation, training and
scoring of tabular data.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects and is built
from Catalyst expressions (``pyspark.sql.functions``) or ``pyspark.ml`` stages,
so the heavy lifting runs on the executors.
"""

from quarry.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
