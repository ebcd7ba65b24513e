"""Conversion plans and the jobs that carry them out."""
