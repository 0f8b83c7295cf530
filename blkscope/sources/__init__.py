"""Logs, pattern registry and trace tables at rest."""
