"""Where an ingest reads, where it stores, and how much it takes at once."""

import re
from dataclasses import dataclass

# Records of one micro-batch at most, so that a backlog becomes many batches, not one.
BATCH_RECORDS = 20_000_000
BATCH_FILES = 1_000


def _required(**values: str) -> None:
    for name, value in values.items():
        if not value or not value.strip():
            raise ValueError(f"{name} is empty")


@dataclass(frozen=True)
class Store:
    """The datasets of one version of the outputs below a base folder."""

    base: str
    version: str = "v1"

    def __post_init__(self) -> None:
        _required(base=self.base, version=self.version)
        if not re.fullmatch("v[1-9][0-9]*", self.version):
            raise ValueError(f"version {self.version!r} is not v1, v2, ...")

    def dataset(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{self.version}/{name}"

    raw_events = property(lambda self: self.dataset("raw_events"))
    clean_events = property(lambda self: self.dataset("clean_events"))
    dead_letter = property(lambda self: self.dataset("dead_letter"))
    quality_metrics = property(lambda self: self.dataset("quality_metrics"))
    hourly_airline_deltas = property(lambda self: self.dataset("hourly_airline_deltas"))
    hourly_airline_metrics = property(lambda self: self.dataset("hourly_airline_metrics"))
    hourly_airline_runs = property(lambda self: self.dataset("hourly_airline_runs"))
    clean_by_date = property(lambda self: self.dataset("clean_events_by_date"))
    seen_events = property(lambda self: self.dataset("seen_events"))
    commits = property(lambda self: self.dataset("_commits"))
    ledger = property(lambda self: self.dataset("_ledger"))


@dataclass(frozen=True)
class Ingest:
    """A store, its stream's checkpoint, and the pause between batches.

    Without ``every`` the stream takes what there is and ends.
    """

    store: Store
    checkpoint: str
    every: str | None = None

    def __post_init__(self) -> None:
        _required(checkpoint=self.checkpoint)
        if self.every is not None:
            _required(every=self.every)


@dataclass(frozen=True)
class Topic:
    """A broker topic and how to read it; ``read_tasks`` splits few but large partitions."""

    servers: str
    name: str
    from_start: bool = True
    batch_records: int = BATCH_RECORDS
    read_tasks: int | None = None

    def __post_init__(self) -> None:
        _required(servers=self.servers, name=self.name)
        if self.batch_records < 1 or (self.read_tasks is not None and self.read_tasks < 1):
            raise ValueError("batch_records and read_tasks start at 1")
