"""Whole plans: synchronising, hunting, reviewing and publishing."""
