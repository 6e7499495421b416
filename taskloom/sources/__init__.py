"""Readers, writers and views that present stored tables as task tables."""
