"""Readers of traces and of run folders."""
