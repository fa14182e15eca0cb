"""Registered queries, their SQL, and the pipelines that put operators together."""
