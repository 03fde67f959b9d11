"""Marlstone streaming."""
