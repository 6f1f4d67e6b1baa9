"""Structured Streaming: live indexing, rate limits and circuit breakers."""
