"""Operators for preparing language-model training text, one module each.

Nothing else in the library imports this subpackage.  Shared conventions:

* an operator takes DataFrames and column names, selects only what it needs
  first (extra or clashing columns never reach its plan) and returns one row
  per input row unless its docstring says otherwise;
* a null text is an empty text; a null id is hashed as the empty string;
* what must be computed once and read by several branches is written as
  Parquet under the cluster's ``spark.checkpoint.dir``.
"""
