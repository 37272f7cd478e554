"""The kernels' problem classes: workload sizes by name."""

from __future__ import annotations

from dataclasses import dataclass

NAMES = ("tiny", "small", "standard", "large", "huge")


@dataclass(frozen=True)
class Problem:
    kernel: str
    name: str
    sizes: tuple[int, ...]


#: The sizes of each kernel's classes, tiny to huge.
SIZES: dict[str, tuple[tuple[int, ...], ...]] = {
    "fast": ((2048,), (4096,), (8192,), (16384,), (24576,)),  # image side
    "friendly": ((10001, 14096), (100001, 116384), (500001, 532768), (2000001, 2032768), (8000001, 8065536)),  # first, last
    "gauss": ((7, 70), (7, 4096), (11, 8192), (11, 16384), (15, 32768)),  # mask side, image side
    "sort": ((8388608,), (16777216,), (33554432,), (67108864,), (134217728,)),  # integers
    "kmeans": ((4096, 256), (8192, 512), (16384, 1024), (32768, 1024), (65536, 1024)),  # points, centroids
    "lu": ((512,), (1024,), (1536,), (2048,), (2560,)),  # matrix side
    "tsp": ((14,), (15,), (17,), (19,), (20,)),  # towns
    "nbody": ((8192, 24), (16384, 12), (16384, 24), (32768, 12), (32768, 24)),  # bodies, steps
    "raytrace": ((1280, 720, 10), (1600, 900, 30), (1920, 1080, 50), (2048, 1152, 70), (2560, 1440, 90)),  # width, height, depth
}


def problem(kernel: str, name: str = "standard") -> Problem:
    if kernel not in SIZES or name not in NAMES:
        raise ValueError(f"no class {name!r} of kernel {kernel!r}")
    return Problem(kernel, name, SIZES[kernel][NAMES.index(name)])
