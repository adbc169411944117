"""Relational operators on records, hits, trees and alignments."""
