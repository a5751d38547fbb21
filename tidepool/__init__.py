"""Spark-native operators for on-chain market data."""
