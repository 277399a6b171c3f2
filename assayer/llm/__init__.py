"""Operators for preparing training text and vectors at corpus scale. Nothing outside this package imports it."""
