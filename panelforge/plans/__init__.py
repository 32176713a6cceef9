"""Registered queries over the star-schema tables and their SQL counterparts."""
