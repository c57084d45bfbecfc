"""Operators on text corpora: deduplication, classification, scoring, packing and binary output."""
