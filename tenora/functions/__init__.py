"""Column expressions shared by the queries and jobs."""
