"""Models: trained with NumPy on the driver from bounded matrices, applied by Arrow batches with broadcast weights."""
