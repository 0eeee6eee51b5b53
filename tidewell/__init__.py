"""A PySpark-native SQL, retrieval and data-processing engine.

Column helpers live in ``functions``, table operators in ``operators``,
readers and the catalog in ``sources``, registered queries in ``plans``,
continuous variants in ``streaming``.  Everything is built on DataFrames, so
Catalyst plans it and AQE adjusts it at run time.
"""
