"""Operators of a training-data pipeline: sharding, mixing, near duplicates, chat formatting, PII, language, tokens."""
