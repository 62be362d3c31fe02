"""Operators for text collections used as training data; nothing else in the library imports them."""
