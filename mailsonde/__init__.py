"""Spark-first analytics for passive e-mail transport forensics."""
