"""Whole runs: profile, claims and verdicts, and the registered queries."""
