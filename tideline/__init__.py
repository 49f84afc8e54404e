"""Point-in-time analytics for two-sided events, as PySpark DataFrame operators."""
