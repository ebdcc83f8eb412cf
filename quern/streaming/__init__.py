"""Stateful chat sessions on Structured Streaming."""
