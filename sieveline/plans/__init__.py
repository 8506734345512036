"""sieveline plans."""
