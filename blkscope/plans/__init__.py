"""Whole tasks made of the operators: ingest, view, export, session control."""
