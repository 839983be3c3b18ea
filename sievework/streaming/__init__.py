"""Structured Streaming: the request queue and the operation state machine."""
