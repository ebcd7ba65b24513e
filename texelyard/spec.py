"""Driver-side description of a conversion job (plain literals)."""

from __future__ import annotations

from dataclasses import dataclass

ALL_FORMATS = frozenset({"BLP", "BMP", "DDS", "JPEG", "PNG", "TEX", "TGA"})

KEEP_ORIGINAL, MAXIMUM, CUSTOM = 0, 1, 2


@dataclass(frozen=True)
class Step:
    """One transform: ``downscale`` by ``levels`` halvings or ``upscale`` by ``scale``."""

    type: str = "downscale"
    levels: int = 1
    scale: int = 2
    alpha: bool = False

    def __post_init__(self):
        if self.type not in ("downscale", "upscale"):
            raise ValueError(f"unknown step type: {self.type}")


@dataclass(frozen=True)
class JobSpec:
    """Batch options; the defaults are fixed values."""

    input_dir: str = ""
    output_dir: str = ""
    formats: frozenset = ALL_FORMATS
    recursive: bool = True
    keep_layout: bool = True
    output_format: int = 2  # BLP 0, BMP 1, DDS 2, JPEG 3, PNG 4, TGA 5
    blp_version: int = 1  # BLP1 0, BLP2 1
    blp_encoding: int = 0
    blp_dither: bool = False
    blp_dither_strength: float = 0.8
    dds_mode: int = 0  # one format for all 0, per kind 1
    dds_format_general: int = 7
    dds_invert_y_general: bool = False
    dds_format_normal: int = 5
    dds_invert_y_normal: bool = False
    dds_format_channel: int = 4
    dds_format_other: int = 7
    jpeg_quality: int = 75
    jpeg_progressive: bool = False
    generate_mipmaps: bool = False
    mipmap_mode: int = KEEP_ORIGINAL
    mipmap_custom_count: int = 1
    steps: tuple = ()
