"""Searches, catalogue queries and statistics over the tables."""
