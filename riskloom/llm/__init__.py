"""Operators of a pipeline for training data: each one a module, their queries in ``registry``."""
