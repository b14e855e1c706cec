"""The same folds and triggers over streams."""
