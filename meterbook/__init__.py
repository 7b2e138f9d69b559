"""Metered-usage ledgers and reports as Spark DataFrame operators."""
