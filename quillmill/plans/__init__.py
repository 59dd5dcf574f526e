"""Whole dataflows and the catalogue of registered queries."""
