"""Operators for building training text: filters, duplicates, tokens, packing, web archives."""
