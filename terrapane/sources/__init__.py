"""Readers and writers: arrays, images, vectors, registries' files."""
