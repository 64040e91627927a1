"""textsql: DataFrame operators for building, scoring and comparing text-to-SQL data on Spark.

Layout
------
functions/  Column builders (pure expressions, codegen-friendly, no Python UDFs)
operators/  DataFrame -> DataFrame operators (joins, aggregates, ranking, execution)
sources/    readers and writers (catalog JSON, JSONL corpora, evaluator files)
plans/      the scaled views over the driver tables and the registered queries
streaming/  Structured Streaming variants of the incremental operators
"""

__version__ = "0.1.0"
