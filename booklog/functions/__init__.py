from .identity import event_id, group_id_of, partition_key
from .text import evaluate_once, split_stripped, strip

__all__ = [
    "evaluate_once",
    "event_id",
    "group_id_of",
    "partition_key",
    "split_stripped",
    "strip",
]
