"""Record files that keep arriving: sorted runs from a stream of records."""
