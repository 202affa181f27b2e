"""Operators for preparing training corpora: dedup, scoring, mixing, formatting, packing."""
