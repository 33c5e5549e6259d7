"""Siltstone: document retrieval, knowledge graphs and analytics as Spark DataFrames."""
