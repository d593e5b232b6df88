"""tenora: multi-tenant workspace analytics and corpus preparation on PySpark."""
