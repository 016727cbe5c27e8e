"""Structured Streaming: epochs of batches, their processing, and event-time windows."""
