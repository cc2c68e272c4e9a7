"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  ``bitsift.llm.queries`` holds the
contract queries, the other modules the operators behind them.
"""
