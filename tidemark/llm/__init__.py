"""Operators for preparing training text at scale: extraction, search, filters, near copies, packing, tokens, PII."""
