"""Forward kinematics of a chain of joints, vectorised over rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Joint:
    """A fixed offset and turn, then a turn about axis by the joint's value (None: fixed)."""

    name: str
    offset: tuple[float, float, float]
    turn: tuple[float, float, float]
    axis: tuple[float, float, float] | None


def from_euler(roll: float, pitch: float, yaw: float) -> np.ndarray:
    """Turn about x, then y, then z."""
    x, y, z = (about(np.eye(3)[i], np.array([a]))[0] for i, a in enumerate((roll, pitch, yaw)))
    return z @ y @ x


def about(axis: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Rotation matrices about an axis, one per angle."""
    x, y, z = axis / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle)[:, None, None] * k + (1 - np.cos(angle))[:, None, None] * (k @ k)


#: The way from a link to the root, one joint a level; no chain is longer than the table, so a loop ends as well.
ANCESTRY = """
    WITH RECURSIVE up (name, type, xyz, rpy, axis, parent, level) AS (
        SELECT name, type, xyz, rpy, axis, parent, 0 FROM {joints} WHERE child = :tip
        UNION ALL
        SELECT j.name, j.type, j.xyz, j.rpy, j.axis, j.parent, up.level + 1 FROM up JOIN {joints} j ON j.child = up.parent WHERE up.level + 1 < :most)
    SELECT name, xyz, rpy, CASE WHEN type IN ('revolute', 'continuous') THEN axis END AS axis FROM up ORDER BY level DESC"""


def chain_to(joints: DataFrame, tip: str) -> list[Joint]:
    """The joints from the root to a link, from sources.files.urdf_joints(); a robot's description is small."""
    found = joints.sparkSession.sql(ANCESTRY, {"tip": tip, "most": joints.count()}, joints=joints)
    return [Joint(r["name"], tuple(r["xyz"]), tuple(r["rpy"]), tuple(r["axis"]) if r["axis"] else None) for r in found.collect()]


def frame(turn: np.ndarray, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> np.ndarray:
    """Homogeneous matrices of turns with an offset before them."""
    out = np.zeros((*turn.shape[:-2], 4, 4))
    out[..., :3, :3], out[..., :3, 3], out[..., 3, 3] = turn, offset, 1
    return out


def tips(chain: list[Joint], values: np.ndarray) -> np.ndarray:
    """Positions of the tip for rows of values, one for each joint that moves, in order.

    Joints that don't move between two that do are one constant matrix; what is left is a product of as many stacks of
    matrices as the chain has moving joints.
    """
    stacks, still, columns = [], np.eye(4), iter(values.T)
    for joint in chain:
        still = still @ frame(from_euler(*joint.turn), joint.offset)
        if joint.axis is not None:
            stacks.append(still @ frame(about(np.array(joint.axis), next(columns))))
            still = np.eye(4)
    whole = reduce(np.matmul, [*stacks, still])
    return np.broadcast_to(whole[..., :3, 3], (len(values), 3))


def tip_position(chain: list[Joint], vector: Column) -> Column:
    """The tip's position for a vector column; further entries than joints are ignored, missing and null ones are 0, and
    a null vector has no position."""
    moving = sum(j.axis is not None for j in chain)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(tips(chain, np.stack(s.to_numpy()))), dtype=object)

    entries = [F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)).cast("double") for i in range(moving)]
    return F.when(vector.isNotNull(), run(F.array(*entries) if entries else F.array(F.lit(0.0))))
