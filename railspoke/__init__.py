"""Railspoke: Spark-native analytics over tiled bike-and-rail graphs.

Every operator takes and returns DataFrames. The sub-packages are
``functions`` (column expressions), ``operators`` (DataFrame transformations),
``sources`` (tables, tiles, derived fixture), ``plans`` (registered queries and
their SQL) and ``streaming``. The sub-package ``llm`` is optional: nothing
outside it imports it.
"""
