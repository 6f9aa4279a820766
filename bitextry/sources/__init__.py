"""Readers and writers. Row order is data: every reader numbers its lines, every writer keeps them in order."""
