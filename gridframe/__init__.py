"""Analytics over gridded data on Spark: layers of cells, neighbourhoods, zones, distances and measures."""
