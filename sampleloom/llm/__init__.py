"""Operators for large-scale training-data preparation.

Nothing else in :mod:`sampleloom` imports this subpackage.  Every operator is a
function over DataFrames; the queries built from them are in
:mod:`sampleloom.llm.queries`.
"""
