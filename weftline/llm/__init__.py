"""Training-data operators: deduplication, scoring, tokenising, packing and search.

Nothing outside this folder imports it. Shared numeric helpers are in ``bytescan`` and
``storage``; each operator has a module of its own, and ``queries`` registers them.
"""
