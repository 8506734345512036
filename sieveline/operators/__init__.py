"""sieveline operators."""
