"""Spark-native engine that turns collections of chat logs into an auditable knowledge network."""
