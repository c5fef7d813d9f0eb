"""Signals from tables, files and generators."""
