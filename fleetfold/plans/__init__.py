"""Declared map/reduce queries and the catalogue of stock ones."""
