"""Operators for text collections that language models are trained on.

Nothing else in the package imports this folder.
"""
