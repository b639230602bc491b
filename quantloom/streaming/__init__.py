"""Streaming counterparts of batch aggregates."""
