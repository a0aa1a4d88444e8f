"""Structured Streaming forms of batch behaviour, offered as extensions."""
