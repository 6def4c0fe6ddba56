"""Point-in-time event analytics on Spark: plain DataFrame-to-DataFrame operators."""
