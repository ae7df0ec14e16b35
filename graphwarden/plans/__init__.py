"""Profiles of rules, and validation runs over modules and their union."""
