"""Operators on tables of listings, offers, matches and reviews."""
