"""sieveline sources."""
