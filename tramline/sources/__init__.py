"""Readers and writers of schedules."""
