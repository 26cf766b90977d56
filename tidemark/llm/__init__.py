"""Operators for building training corpora: packing, joins, tokenizers, sharding, scoring, dedup, rules, archives."""
