"""Where rows come from and go to: versioned Parquet tables, and external files."""
