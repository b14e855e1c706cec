"""Reading and writing facts, values and logs."""
