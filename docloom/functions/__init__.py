"""Functions of the document analytics engine."""
