"""Medallion analytics on Spark: profile, check, clean, aggregate and explain tables.

Every operator is a plain function over DataFrames, so it can be chained with
``df.transform`` and planned by Catalyst as one query.
"""

__version__ = "0.1.0"
