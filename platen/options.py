"""Options of a run, their ranges, and the checks on inputs and outputs."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field
from pathlib import PurePath

import numpy as np

#: What the extractor looks for without prompts of its own. Fixed values.
PROMPTS = ("photo", "document", "card", "booklet", "leaflet", "disc")
EXTRACTORS = ("alpha", "background", "instances")


@dataclass(frozen=True)
class Options:
    """extractor: how masks are read. alpha: the first mask is an alpha channel, cut at threshold percent; background: all masks together
    are what isn't an object; instances: each is an object, those that overlap by more than overlap are one."""

    extractor: str = "alpha"
    overlap: float = 0.001
    prompts: tuple[str, ...] = field(default=())
    threshold: float = 95.0
    min_area: int = 0
    min_side_percent: float = 10.0
    angle_tolerance: float = 10.0
    text: bool = False
    rectangularity: float = 0.30
    force_rectangular: bool = False
    padding: float = 2.0
    alpha: bool = False
    allow_lossy: bool = False
    no_deskew: bool = False
    no_doc_orient: bool = False
    doc_model: str | None = "onnx/bkori.onnx"
    overwrite: bool = False
    safezone: bool = False
    debug: bool = False

    def __post_init__(self) -> None:
        ranges = {"overlap": 1.0, "threshold": 100.0, "rectangularity": 1.0, "padding": 100.0, "min_side_percent": 100.0}
        for name, top in ranges.items():
            if not 0 <= getattr(self, name) <= top:
                raise ValueError(f"{name} must be between 0 and {top:g}, got {getattr(self, name)}")
        if self.extractor not in EXTRACTORS:
            raise ValueError(f"extractor must be one of {', '.join(EXTRACTORS)}, got {self.extractor}")
        if self.text and self.force_rectangular:
            raise ValueError("text and force_rectangular exclude each other")

    @property
    def cutoff(self) -> int:
        """The alpha from which a pixel is foreground, by single-precision arithmetic."""
        return math.floor(float(np.float32(self.threshold) / np.float32(100) * np.float32(255)) + 0.5)

    @property
    def rectangle_threshold(self) -> float:
        return 0.0 if self.force_rectangular else self.rectangularity

    def object_prompts(self) -> tuple[str, ...]:
        return self.prompts or PROMPTS

    def doc_model_path(self, beside: str) -> str | None:
        """The document model's file; a relative path is one beside the program."""
        return None if self.doc_model is None else self.doc_model if PurePath(self.doc_model).is_absolute() else os.path.join(beside, self.doc_model)


def inputs_of(paths: list[str], single: str | None) -> list[str]:
    """The inputs: paths, or one input by name, not both and not neither."""
    if paths and single is not None:
        raise ValueError("give inputs as paths or by name, not both")
    if not paths and single is None:
        raise ValueError("no input given")
    return list(paths) if paths else [single]


def check_output(output: str | None, output_dir: str | None, inputs: list[str], is_file: bool) -> None:
    """One output's name goes with one image file alone, and not with a folder for outputs."""
    if output is None:
        return
    if output_dir is not None:
        raise ValueError("output and output_dir exclude each other")
    if len(inputs) != 1 or not is_file:
        raise ValueError("output needs a single image file as input")
