"""Whole jobs made of the operators, and the standard rule table."""
