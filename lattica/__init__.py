"""Spark-native program analysis: relations over programs computed by fixpoint loops on DataFrames."""
