"""Whole-stage plans over the shared tables, and the command line."""
