"""Training-data operators: quality, near and exact copies, packing, chat format, BPE, embeddings, secrets, toxicity, shards.

Nothing outside this subpackage imports it.
"""
