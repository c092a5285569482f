"""Column expressions. Every function takes and returns ``Column`` objects
built from ``pyspark.sql.functions``; nothing here runs Python per row."""
