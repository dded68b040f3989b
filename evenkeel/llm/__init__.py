"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator; the
queries over the driver's tables are in :mod:`evenkeel.llm.queries`.
"""
