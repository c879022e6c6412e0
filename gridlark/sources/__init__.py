"""Where rows come from: Parquet tables, catalog listings, seed tables, file footers."""
