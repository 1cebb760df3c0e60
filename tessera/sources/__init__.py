"""Where rows come from: versioned tables, external Parquet, key-value logs."""
