"""Product-offer analytics as PySpark DataFrame functions."""
