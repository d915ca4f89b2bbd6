"""Operators for training-data corpora. Nothing else in corrgrid imports this subpackage."""
