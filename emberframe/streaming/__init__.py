"""Repeat runs.

The model has no event-time streams; its one incremental feature is resuming by status, which is
a daily batch here.
"""
