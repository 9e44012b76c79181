"""Training-data operators: thirteen operators on ``documents``-like tables, pages, conversations and embeddings.

Nothing outside this package imports it.
"""
