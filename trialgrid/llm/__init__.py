"""Operators for preparing training text and embeddings at scale.

Nothing outside this subpackage imports it.
"""
