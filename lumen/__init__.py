"""Spark-native album similarity, graph analytics and corpus operators."""
