"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. ``entries`` registers its queries.
"""
