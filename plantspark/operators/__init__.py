"""Operators on the long ``readings`` table and on wide plant tables derived from it."""
