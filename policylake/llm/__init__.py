"""Operators for preparing training text, and the queries that run them.

Nothing outside this folder imports it, apart from the guarded line in ``__spark_entry__.py``
and ``corpus_pipeline.py``, which counts as part of it.
"""
