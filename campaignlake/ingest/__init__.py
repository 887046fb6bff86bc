"""Batch ingestion jobs and their ledgers."""
