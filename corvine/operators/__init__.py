"""Operators on ranked lists, chunks, graphs and logs."""
