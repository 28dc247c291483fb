"""Readers of episode records, job folders, logs and scripts; writers of results."""
