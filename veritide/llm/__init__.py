"""Operators for large text-corpus pipelines.

Nothing outside this package imports it.
"""
