"""Posting tables, batch search and catalog deltas."""
