"""tieweave: relationship-network analytics expressed as Spark DataFrame jobs."""
