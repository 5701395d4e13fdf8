"""Whole runs: projects and their commands, and the registered queries."""
