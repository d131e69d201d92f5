"""Sensitive-text analytics on Spark: normalise, detect, decide, report."""
