"""Operators for preparing training text.

Ten operators on a ``documents(doc_id, text, lang, source, n_chars)`` table and the queries that
run them.  Nothing outside this subpackage imports it.
"""
