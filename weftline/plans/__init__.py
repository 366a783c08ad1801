"""Registered queries by area, with their SQL."""
