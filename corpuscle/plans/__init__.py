"""Registered queries with their SQL, and the stage-by-stage corpus build."""
