"""Registered queries: each operator on the test tables, with equivalent SQL."""
