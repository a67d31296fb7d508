"""Training-data operators: whole-corpus scans, joins, packing and scoring.

Nothing outside this subpackage imports it.
"""
