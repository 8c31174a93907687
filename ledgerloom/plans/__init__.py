"""Recipes, their log, and suggestions for further steps."""
