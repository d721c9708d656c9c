"""Operators that prepare text for language-model training. Nothing else in the package imports them."""
