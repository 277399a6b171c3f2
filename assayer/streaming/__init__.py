"""Arrivals, lifecycle and decisions as streams, each with a batch twin."""
