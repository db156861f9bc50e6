"""Whole plans: scans, crawls and the catalogue of queries."""
