"""Table declarations, JSON ingest, JSON-lines datasets, configuration structs and snapshots."""
