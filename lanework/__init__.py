"""Feed-catalog jobs for Spark: batch and streaming operators over catalog documents, entries, scans and ownership events."""
