"""Spark jobs over a fleet's command-event log: ingest, privacy policy, search, ranking, prediction."""
