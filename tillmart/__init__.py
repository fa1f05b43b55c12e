"""Retail sales analytics on Spark: clean, normalise, gate, merge, monitor, analyse."""
