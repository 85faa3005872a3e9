"""Readers, writers and the deterministic timetable projection."""
