"""Operators for large training-data pipelines.

Nothing outside this package imports it.  One module per operator, each with a
general interface; ``queries`` holds the thin ``opN_<name>`` queries.
"""
