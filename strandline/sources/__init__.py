"""Readers, writers and row validation."""
