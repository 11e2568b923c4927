"""Training-data operators (chat formatting, sharding, deduplication, packing, ...).

Nothing outside this folder imports it; its queries are in ``queries.py``.
"""
