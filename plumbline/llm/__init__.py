"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; its queries and SQL are
collected in :mod:`plumbline.llm.queries`.
"""
