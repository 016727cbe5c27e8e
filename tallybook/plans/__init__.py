"""Plans: the request facade, and the registered queries over the driver's tables."""
