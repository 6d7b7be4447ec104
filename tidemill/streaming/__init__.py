"""Structured Streaming: deduplication, windows and keyed state for queues, quotas and request rates."""
