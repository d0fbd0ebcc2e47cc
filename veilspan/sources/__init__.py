"""Readers and writers of corpora, releases, metrics and run folders."""
