"""Versioned JSON records in an append-only change log, as DataFrame and SQL plans."""
