"""Configurations of genomes: which source each has, and named batches of them. A small mapping on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from strandline.sources.adapters import SOURCES

REQUIRED = ("species", "source")


class Registry:
    """Labels with their settings, and batches (lists of labels). Files are JSON objects, or lists of labels, one a line."""

    def __init__(self) -> None:
        self.genomes: dict[str, dict] = {}
        self.batches: dict[str, list[str]] = {}

    def load(self, folder: str) -> None:
        """Settings from *.json (label to settings), batches from *.txt; later files add to earlier ones."""
        for p in sorted(Path(folder).glob("*.json")):
            self.update(json.loads(p.read_text()))
        for p in sorted(Path(folder).glob("*.txt")):
            self.batches[p.stem] = [x.strip() for x in p.read_text().splitlines() if x.strip() and not x.startswith("#")]

    def update(self, more: dict[str, dict]) -> None:
        for label, settings in more.items():
            self.check(label, settings)
            self.genomes[label] = self.genomes.get(label, {}) | settings

    @staticmethod
    def check(label: str, settings: dict) -> None:
        lacking = [k for k in REQUIRED if not settings.get(k)]
        if lacking:
            raise ValueError(f"{label} lacks {', '.join(lacking)}")
        if settings["source"] not in SOURCES:
            raise ValueError(f"{label} has an unknown source: {settings['source']}")

    def genome(self, label: str) -> dict:
        return self.genomes[label]

    def batch(self, name: str) -> Iterator[tuple[str, dict]]:
        for label in self.batches[name]:
            yield label, self.genomes[label]

    def labels(self, source: str | None = None) -> list[str]:
        return sorted(k for k, v in self.genomes.items() if source in (None, v["source"]))

    @classmethod
    def of(cls, rows: Iterable) -> Registry:
        """From rows with label and settings; those without what is required are left out."""
        r = cls()
        for x in rows:
            d = {k: v for k, v in x.asDict().items() if k != "label" and v is not None}
            if x["label"] and d.get("species") and d.get("source") in SOURCES:
                r.update({x["label"]: d})
        return r
