"""From rule expressions to Spark columns."""
