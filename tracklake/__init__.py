"""Vessel-track analytics on Spark: ingest, track detectors, loitering pairs, risk ranking."""
