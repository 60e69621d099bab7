"""weirflow: flow-state analytics over packet tables, written for Spark's DataFrame engine."""
