"""Readers and writers: survey files, run directories, archives, sinks."""
