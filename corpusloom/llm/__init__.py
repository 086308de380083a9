"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, names the columns it reads, ignores all others and states in
its docstring what nulls, empty texts, ties and repeated rows give.
"""
