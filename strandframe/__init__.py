"""Sequence files as Spark tables: scans, validation, pairing, packing, statistics, indexes, block-gzip."""
