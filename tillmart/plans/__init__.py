"""Analytic queries on the star schema."""
