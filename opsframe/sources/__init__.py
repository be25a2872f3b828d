"""SQL scripts, sync jobs, JDBC reads, partition writes and cube segments."""
