"""Campaign analytics on Spark: idempotent batch ingest and declarative sheet exports."""
