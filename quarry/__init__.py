"""A PySpark-native analytics engine: DataFrame-to-DataFrame operators.

Sub-packages: ``sources`` (readers and writers), ``functions`` (Column
expressions), ``operators`` (statistics, text, series, graph, clustering,
metrics, sampling), ``plans`` (registered queries with their oracles),
``streaming`` (Structured Streaming operators).
"""
