"""Training-data operators (scoring, dedup, mixing, PII, chat, packing, sharding)."""
