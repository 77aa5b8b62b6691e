"""Functions of the clustered analytics engine."""
