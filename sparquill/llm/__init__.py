"""Training-data operators: quality, deduplication, scans, tokenising, mixing.

Nothing outside this package imports it; the entry module adds its queries when it is present.
"""
