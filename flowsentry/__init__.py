"""Spark-native transaction-risk analytics on account-to-account transfers."""
