"""Marlstone: a Spark-native engine for self-describing, content-addressed data."""
