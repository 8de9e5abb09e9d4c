"""Reports and studies composed from the operators."""
