"""Operators for preparing text corpora for training. Nothing else in the library imports this subpackage.

Conventions that hold for every operator: a null text counts as an empty one; only the named columns of the input are
read unless an operator says that it keeps all columns, so extra columns never clash; an empty table gives an empty
result with the same columns; repeated rows give repeated results.
"""
