"""Spark-native search, crawl analytics and training-data preparation."""
