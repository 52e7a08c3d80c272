"""Event-intelligence analytics on Spark: declarative operators over observation tables."""
