"""Readers, writers and table-level checks for tapes, bars, masters and catalogues."""
