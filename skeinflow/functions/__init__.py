"""Scalar functions as Catalyst expressions; Python only where none can express them."""
