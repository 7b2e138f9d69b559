"""Readers and writers.  Schemas are fixed; nothing is inferred from the data.

Each reader has a ``parse_…`` half that works on a DataFrame of raw texts, so text
that already sits in a table needs no file.
"""
