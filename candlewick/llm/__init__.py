"""Operators for preparing large text corpora as training data.

Nothing outside this subpackage imports it; its queries are added to the
registry only when it can be imported.
"""
