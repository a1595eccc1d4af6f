"""Derived corpora, registered queries and their SQL counterparts."""
