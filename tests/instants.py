"""Instants written as text."""

from datetime import datetime, timezone


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
