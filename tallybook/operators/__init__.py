"""Operators on tables of events, batches and epochs."""
