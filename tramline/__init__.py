"""Public-transit timetable analytics on Spark DataFrames."""
