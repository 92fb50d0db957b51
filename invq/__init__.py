"""Fleet-scale questions over infrastructure inventory, logs and polled state, as Spark jobs."""
