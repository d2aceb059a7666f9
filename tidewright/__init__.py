"""Tidewright: table analytics written as Spark DataFrame and SQL queries."""
