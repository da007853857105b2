"""Plans: the query catalogue, end-to-end chains and parameter sweeps."""
