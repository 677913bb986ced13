"""Ledgerwell: portfolio analytics as declarative Spark plans."""
