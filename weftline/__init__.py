"""weftline: a Spark-first engine for web, feed, document and Markdown dataflows.

Operators are plain functions from DataFrames (or Columns) to DataFrames (or Columns); Catalyst chooses the physical
plan. Clocks, thresholds and paths are always parameters.
"""

__version__ = "0.1.0"
