"""Names and fixed values of the motion tables."""

from __future__ import annotations

# The joints in their order, the limbs as (parent, end), the body regions.
JOINTS = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)
LIMBS = ((5, 7), (7, 9), (6, 8), (8, 10), (11, 13), (13, 15), (12, 14), (14, 16))
REGIONS = {"head": (0, 1, 2, 3, 4), "arms": (5, 6, 7, 8, 9, 10), "torso": (11, 12), "legs": (13, 14, 15, 16)}
REGION_OF = {j: name for name, joints in REGIONS.items() for j in joints}

#: A joint counts as seen from this confidence on.
VISIBLE = 0.3

RECORD = (
    "frame bigint, t double, id_type string, "
    "people array<struct<id: bigint, bbox: array<double>, conf: double, keypoints: map<string, array<double>>>>, "
    "poses array<struct<id: bigint, landmarks: map<string, array<double>>>>, "
    "hands array<struct<handedness: string, score: double, landmarks: map<string, array<double>>>>"
)
