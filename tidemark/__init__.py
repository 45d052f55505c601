"""Versioned time-series assets on Spark: scans, current and point-in-time reads, roll-ups, coverage, planning and quality."""
