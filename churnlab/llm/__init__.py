"""Operators of a training-data pipeline (numbered 1-10) and their queries.

Nothing outside this package imports it; ``__spark_entry__`` adds
:func:`churnlab.llm.queries.queries` when the package is present.
"""
