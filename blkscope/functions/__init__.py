"""Column functions and plan-time helpers."""
