"""Checklists and registered queries."""
