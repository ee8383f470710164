"""ledgerloom: cloud-bill analytics expressed as Spark DataFrame jobs."""
