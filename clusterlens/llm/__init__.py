"""Operators for preparing text training data, one module per operator.

Nothing outside this subpackage (and the pipeline module that composes it) imports from here.
"""
