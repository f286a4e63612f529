"""Markdown and HTML reports."""
