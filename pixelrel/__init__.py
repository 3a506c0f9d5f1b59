"""Image and byte analytics on Spark relations."""
