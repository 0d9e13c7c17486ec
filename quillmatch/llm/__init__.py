"""Training-data operators: dedup, quality, tokens, decontamination, search, chat, packing, urls, shards.

Nothing outside this subpackage imports it.
"""
