"""Registered queries by milestone; each stands beside the SQL that gives the same rows."""
