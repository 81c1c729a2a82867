"""groundwire: reference checking, grounded notes and training-data operators on Spark."""
