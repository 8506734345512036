"""sieveline functions."""
