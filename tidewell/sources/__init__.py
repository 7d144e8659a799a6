"""Readers and writers: tables, object stores, snapshots, logs, event streams."""
