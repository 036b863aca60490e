"""Spark-native analytics over order, stock, customer and ledger data."""
