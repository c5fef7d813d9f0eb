"""Whole analyses: the record pipeline, reports, plot data and the driver's queries."""
