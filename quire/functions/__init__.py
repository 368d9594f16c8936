"""Column functions and numpy block kernels: hashing, vectors, id-key parsing, text encoders."""
