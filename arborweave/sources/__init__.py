"""Readers and writers of sequence, graph, tree and record formats."""
