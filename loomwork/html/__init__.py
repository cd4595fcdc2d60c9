"""HTML as nested records: one parse per page inside an Arrow UDF, everything else in columns."""
