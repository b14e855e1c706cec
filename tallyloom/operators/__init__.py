"""Reads, roll-ups, joins, differences, audits and policies over facts and folded state."""
