"""Distributed DataFrame operators."""
