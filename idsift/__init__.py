"""Identity-record verification and evidence scoring as PySpark DataFrame jobs."""
