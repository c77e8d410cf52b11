"""End-to-end runs that a user calls."""
