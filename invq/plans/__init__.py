"""Registered queries: each pairs a Spark plan over the supplied tables with its SQL check."""
