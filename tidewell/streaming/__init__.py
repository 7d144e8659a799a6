"""Stateful processing of upload and job events."""
