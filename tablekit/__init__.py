"""tablekit: table browsing, profiling and SQL cells as plain Spark DataFrame functions.

Every public function takes and returns ``pyspark.sql.DataFrame`` (or a small
driver-side value computed from a bounded aggregate), so plans stay lazy and
Catalyst decides the physical strategy.
"""

__version__ = "0.1.0"
