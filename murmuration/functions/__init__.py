"""Column-level functions (P*): pure ``Column -> Column`` expressions.

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen; none is a Python UDF.
"""
