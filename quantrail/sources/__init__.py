"""Readers for spreadsheet and locale-formatted files."""
