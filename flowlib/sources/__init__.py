"""Readers and writers: raw CSV, silver and split tables, prediction artifacts, summaries, lookups."""
