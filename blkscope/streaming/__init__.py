"""Structured Streaming over growing logs."""
