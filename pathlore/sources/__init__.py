"""Listings in, catalogs and posting tables out and in again."""
