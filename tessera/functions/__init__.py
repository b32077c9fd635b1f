"""Expression semantics as Spark columns."""
