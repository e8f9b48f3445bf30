"""Readers and writers of annotation, interval and matrix formats."""
