"""Spark-native payment-risk analytics: features, cost-based decisions, evaluation and monitoring."""
