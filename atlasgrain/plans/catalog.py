"""All queries of the reference's operators, with their SQL."""

from ..operators import contracts, evidence, files, frames, integrity, mattes, pixels, poses, requests, segmentation, sequences, transforms, video  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
