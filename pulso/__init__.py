"""pulso: social-opinion analytics as Spark DataFrame operators.

Every public operator takes and returns ``pyspark.sql.DataFrame`` (or a
``Column`` for scalar functions) and builds on Spark SQL, Spark ML and
Structured Streaming. Sub-packages:

* ``sources``   -- table I/O, schemas, fixture views over the test tables
* ``functions`` -- column expressions (text cleaning, dates, sentiment)
* ``operators`` -- DataFrame -> DataFrame operators (daily, polls, metrics...)
* ``plans``     -- composed jobs and the query catalogue with DuckDB oracles
* ``streaming`` -- Structured Streaming forms of the incremental state
"""

__version__ = "0.1.0"
