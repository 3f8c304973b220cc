"""Timed-text analytics on Spark: words, phrases, lines, energy frames and jobs."""
