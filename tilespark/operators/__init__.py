"""Steps of the tile plan: features, grid, geometry, layers, tiles."""
