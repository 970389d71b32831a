"""Queries of the corpus operators; each module registers what it defines."""
