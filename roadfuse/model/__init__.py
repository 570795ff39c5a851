"""The unsupervised sensor model: typed artifact, mixture fit, outlier forest."""
