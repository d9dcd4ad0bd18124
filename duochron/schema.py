"""Schemas of the long tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

C2 = "angle_idx int, i int, j int, c2 double"
ANGLE = "angle_idx int, name string, q double, phi double"
FRAME = "i int, t double"
ISSUE = "severity string, category string, message string, parameter string, value double"

#: Aliases under which a data set's arrays may come.
ALIASES = {
    "c2": ("c2_exp", "c2"),
    "phi": ("phi_angles_list", "phi_angles", "phi"),
    "q": ("wavevector_q_list", "q"),
    "t1": ("t1",),
    "t2": ("t2",),
}


@dataclass(frozen=True)
class Dataset:
    """Cells with their two dimensions. ``c2`` is the only table that grows with the square of the frames."""

    c2: DataFrame
    angle: DataFrame
    frame: DataFrame
    dt: float = 1.0
    length: float = 2e6
