"""Plans: what would be done to resources, endpoints and targets, as rows."""
