"""External batches and incremental runs."""
