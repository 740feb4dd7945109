"""Relational cores: reconciliation, exceptions, run comparison, mastering."""
