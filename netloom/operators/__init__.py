"""Decoding, segmentation and feature families."""
