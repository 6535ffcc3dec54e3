"""Spark-native analytics over maintenance work orders: text clean-up, triples, graph tables and reliability queries."""
