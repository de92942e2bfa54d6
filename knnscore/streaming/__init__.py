"""Scoring inside Structured Streaming."""
