"""A strict transactional SQL dialect and versioned tables on Spark."""
