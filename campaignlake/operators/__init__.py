"""DataFrame operators shared by ingestion, sheets and reports."""
