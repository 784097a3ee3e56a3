"""Configurations, composed plans and registered queries."""
