"""tidewell: snapshot, freshness and replay analytics expressed as Spark plans."""
