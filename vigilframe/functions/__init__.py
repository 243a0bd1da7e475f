"""Scalar expressions over text, hosts, URLs, times and identifiers."""
