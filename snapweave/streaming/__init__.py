"""Releases that arrive one after another."""
