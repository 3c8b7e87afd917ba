"""Operators of a training-data pipeline: token counts, sampled segmentation,
near-duplicate classes, license scans, chat formatting, vector search,
quality rules, packing, language identification and toxicity."""
