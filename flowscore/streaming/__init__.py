"""Streaming queries: scoring messages, replaying datasets as messages."""
