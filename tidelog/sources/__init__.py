"""The event log: ingest, deduplication, change feeds, dimensions and replication."""
