"""Operators on records: sorting, sampling, partitioning, output planning, validation, catalogs."""
