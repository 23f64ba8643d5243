"""Requests as DataFrame plans."""
