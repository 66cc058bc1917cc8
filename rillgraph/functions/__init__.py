"""Part of the segmentation engine."""
