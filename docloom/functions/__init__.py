"""See the package README section for this layer."""
