"""Dataflow graphs: definitions, their rules, gates, and evaluation over many runs at once."""
