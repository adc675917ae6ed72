"""Plans: recorded recipes, stored intermediate tables and graph rounds."""
