"""millrace: DataFrame operators for columnar scans, joins, exchanges, indexes and versioned tables."""
