"""murmuration: social-post network and text analytics on Spark DataFrames.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects;
the heavy lifting is expressed with built-in Spark SQL functions, joins,
aggregations and windows so Catalyst can push filters into scans, prune
columns and plan shuffles.
"""

__version__ = "0.1.0"
