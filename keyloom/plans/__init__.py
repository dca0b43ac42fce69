"""Whole jobs: the file sort, the jobs API, the query catalogue."""
