"""DataFrame -> DataFrame operators; each keeps its work inside Spark plans."""
