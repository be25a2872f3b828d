"""Job data work as Spark DataFrames: statistics, calendars, lineage, sync, series and feeds."""
