"""Plan-level helpers: staged tables, size-checked broadcasts and end-to-end pipelines."""
