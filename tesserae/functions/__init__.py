"""The expression language over nested records, compiled to Spark columns."""
