"""Caching and extension."""

from __future__ import annotations

import importlib

from pyspark import StorageLevel

from tessella.clip import Audio, Clip
from tessella.info import need
from tessella.registry import operator


@operator("std", "Cache", "clip:clip size:int? fixed:int? make_linear:int?")
def cache(clip: Clip, size=None, fixed=None, make_linear=None) -> Clip:
    """The clip itself: caches are set with SetVideoCache."""
    return clip


@operator("std", "SetVideoCache", "clip:clip mode:int? fixedsize:int? maxsize:int? maxhistory:int?")
def set_video_cache(clip: Clip, mode=1, fixedsize=None, maxsize=None, maxhistory=None) -> Clip:
    """Mode 0 drops a cache, others keep the frames on memory and disk for several readers."""
    need(mode in (-1, 0, 1), "SetVideoCache: mode is -1, 0 or 1")
    return clip.but(frames=clip.frames.unpersist() if mode == 0 else clip.frames.persist(StorageLevel.MEMORY_AND_DISK))


@operator("std", "SetAudioCache", "clip:audio mode:int? fixedsize:int? maxsize:int? maxhistory:int?")
def set_audio_cache(clip: Audio, mode=1, fixedsize=None, maxsize=None, maxhistory=None) -> Audio:
    need(mode in (-1, 0, 1), "SetAudioCache: mode is -1, 0 or 1")
    return clip.but(rows=clip.rows.unpersist() if mode == 0 else clip.rows.persist(StorageLevel.MEMORY_AND_DISK))


@operator("std", "SetMaxCPU", "cpu:data")
def set_max_cpu(cpu: str) -> str:
    """Nothing to choose: the JVM picks its instructions."""
    return cpu


@operator("std", "LoadPlugin", "path:data")
def load_plugin(path: str) -> None:
    """Import a module whose functions register themselves with tessella.registry.operator."""
    importlib.import_module(path)


@operator("std", "LoadAllPlugins", "paths:data[]")
def load_all_plugins(paths: list[str]) -> None:
    for path in paths:
        load_plugin(path)
