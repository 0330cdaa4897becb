"""pagetrace: documentation-drift analytics as plain Spark plans."""
