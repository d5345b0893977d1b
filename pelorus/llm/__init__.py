"""Operators for large training-text corpora.

The subpackage stands alone: nothing else in the library imports it, and it
imports nothing from the rest of the library.
"""
