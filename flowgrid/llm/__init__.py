"""Operators for preparing language-model training data.

Nothing else in flowgrid imports this subpackage; it can be removed as a whole.
"""
