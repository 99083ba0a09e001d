"""Event-time analytics on tables and streams with Spark."""
