"""Packet sources."""
