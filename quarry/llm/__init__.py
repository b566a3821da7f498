"""Operators of a training-data pipeline.

Nothing else in the library imports this sub-package; the registered queries
are in :mod:`quarry.llm.queries`.
"""
