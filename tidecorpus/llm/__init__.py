"""Operators of a large-scale training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage. Each module states the
method, what is bounded and by what, and the result for nulls, empty texts,
ties, repeated rows and empty tables. ``queries`` registers one thin query per
operator.
"""
