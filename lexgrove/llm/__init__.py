"""Operators for large training-text corpora; nothing else in the library imports this subpackage.

Ids (doc_id, vec_id, page_id) are numbers, or text that is a number: anything else is an error of the cast to 64 bits. Hash other ids first.
"""
