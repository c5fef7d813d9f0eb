"""Operators on samples, signals, spectra and feature tables."""
