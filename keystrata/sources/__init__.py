"""Sources of the clustered analytics engine."""
