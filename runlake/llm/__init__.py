"""Operators of a training-data pipeline: documents and vectors in, DataFrames out.

Nothing outside this folder imports it. Each module holds one operator; ``shared`` and ``words``
hold what several of them use; ``queries`` registers one query for each operator.
"""
