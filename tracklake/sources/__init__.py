"""Reading and writing tracks, map documents and versioned tables."""
