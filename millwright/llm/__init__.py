"""Operators of a training-data pipeline: thirteen document operators and their registered queries.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
