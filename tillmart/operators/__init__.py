"""Cleaning, normalising, gating, merging and monitoring."""
