"""Spark-first analytics over event-sourced workflow facts."""
