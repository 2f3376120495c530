"""Inputs and outputs: scenes, point tables, over-segmentations, exports."""
