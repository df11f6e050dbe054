"""Spark-native analytics over source corpora, dependency graphs, note vaults, event logs and untrusted text."""
