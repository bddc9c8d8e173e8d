"""Helpers for plans of more than one job."""
