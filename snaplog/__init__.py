"""Versioned key/value data on Spark: an append-only log of (key, seq, kind, value), queried as of any snapshot."""
