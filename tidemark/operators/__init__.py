"""DataFrame to DataFrame operators."""

from tidemark.operators.frames import frame_checksum, frames
from tidemark.operators.ingest import admit_monotonic, assign_sequence, assign_sequence_single, rejects, retain_newest, retain_oldest
from tidemark.operators.ranges import fence_index, lower_bounds, multi_range
from tidemark.operators.scan import in_order, range_scan
from tidemark.operators.split import admit_monotonic_split, assign_sequence_split, places, rejects_split

__all__ = ["admit_monotonic", "admit_monotonic_split", "assign_sequence", "assign_sequence_single", "assign_sequence_split", "fence_index", "frame_checksum", "frames", "in_order", "lower_bounds", "multi_range", "places", "range_scan", "rejects", "rejects_split", "retain_newest", "retain_oldest"]
