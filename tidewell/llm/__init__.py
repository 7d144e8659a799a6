"""Operators for preparing text corpora at scale.

Each module holds one operator with a general interface (its own columns, texts, spans);
``queries`` wraps every operator as a thin ``opN_<name>`` query over the test tables.
Nothing outside this subpackage imports it.
"""
