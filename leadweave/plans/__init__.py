"""Whole jobs: the scan, the reports, and the catalogue of queries with their check SQL."""
