"""Registered queries, their SQL counterparts, and the input shapes both derive from the given tables."""
