"""Operators for preparing training text: sharding, de-duplication, formatting, scoring."""
