"""Position rows and the binary container."""
