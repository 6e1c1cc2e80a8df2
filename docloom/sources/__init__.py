"""Sources of the document analytics engine."""
