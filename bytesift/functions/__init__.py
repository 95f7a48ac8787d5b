"""Scalar functions over file contents: digests, reads, header fields, grams and filters."""
