"""Training-data operators: filtering, joining, mixing, sharding and encoding text at corpus scale."""
