"""Reusable plan shapes and the end-to-end catalogue plan."""
