"""Readers for staged evidence and tables."""
