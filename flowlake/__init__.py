"""Network-flow analytics on Spark: packets to flows, flows to features, features to alerts and metrics."""
