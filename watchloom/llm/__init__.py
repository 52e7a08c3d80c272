"""Training-data operators: deduplication, joins, scans, mixing, encoding, chat repair.

Nothing outside this subpackage imports it.
"""
