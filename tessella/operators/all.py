"""Importing this registers every operator."""

from tessella.operators import audio, calls, control, geometry, merge, point, props, resize, spatial, stats, temporal, text  # noqa: F401
