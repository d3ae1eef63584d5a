"""Profile tables, test column relationships and verify statements about them, as Spark jobs."""
