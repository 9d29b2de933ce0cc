"""Spark-native matching, reconciliation and scoring of positioned observations."""
