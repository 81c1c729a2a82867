"""Operators for large-scale training-data work.  Nothing else in the library imports this."""
