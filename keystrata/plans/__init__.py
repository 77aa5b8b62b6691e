"""Plans of the clustered analytics engine."""
