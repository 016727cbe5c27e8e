"""Readers and writers of events, batches and epoch tables."""
