"""sieveline streaming."""
