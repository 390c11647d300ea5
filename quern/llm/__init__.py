"""Training-data operators: packing, filtering, tokenising, masking, selecting and near-duplicate search."""
