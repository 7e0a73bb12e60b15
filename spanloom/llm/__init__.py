"""Training-data operators: mixing, dedup, token files, scoring, packing, filters and scans.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
