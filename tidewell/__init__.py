"""tidewell: point-in-time news analytics as composable Spark plans."""
