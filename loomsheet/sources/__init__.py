"""Tables: plain parquet, and versioned snapshots with an atomic pointer."""
