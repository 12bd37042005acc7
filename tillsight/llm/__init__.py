"""Operators of a large-scale training-data pipeline (licences, tokens, secrets, near
copies, toxicity, search, URL filters, packing). Nothing else in the library imports this
subpackage; ``queries`` registers one query per operator."""
