"""Where observations and declarations come from."""
