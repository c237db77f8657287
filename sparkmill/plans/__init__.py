"""Queries over tables and whole workflows."""
