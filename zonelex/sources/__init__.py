"""Readers and writers: page dumps, query files, stopword lists, index folders."""
