"""Plan-shape helpers: reliable checkpoints, skew-safe ordered columns, table adapters."""
