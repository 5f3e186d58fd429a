"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes and
returns Spark DataFrames; the thin queries that fix a table, columns and
parameters are in :mod:`lodestone.llm.queries`, the SQL that describes the same
rows, where SQL can, in :mod:`lodestone.llm.oracles`.
"""
