"""Subpackage of splicefind."""
