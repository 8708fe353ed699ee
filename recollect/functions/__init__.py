"""Subpackage of recollect."""
