"""Extractors as plug-ins: what each finds in a file, as rows of several outputs from one read of the files.

An extractor names the languages it reads and yields (output, row) for one file, a row being a dictionary. All
extractors run in the same pass, so a file is read once however many want it; the rows are written once, and every
output is the part of them with its name, in its own schema."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.plans.runtime import cut

#: Outputs that extractors share; others may be added with a schema of their own.
OUTPUTS = {
    "nodes": "key string, type string, name string, line int",
    "edges": "type string, from_key string, to_key string, line int, resolution string, confidence double",
    "unresolved": "kind string, expression string, line int, candidates array<string>",
    "warnings": "warning string",
}
RAW = "path string, extractor string, output string, row string"


@dataclass(frozen=True)
class Extractor:
    name: str
    langs: tuple[str, ...]
    rows: Callable[[str, str], Iterable[tuple[str, dict]]]


class Registry:
    """Extractors by name, in the order in which they were added; a name is taken once."""

    def __init__(self, outputs: dict[str, str] | None = None):
        self.outputs = OUTPUTS | (outputs or {})
        self._known: dict[str, Extractor] = {}

    def add(self, extractor: Extractor) -> Registry:
        if extractor.name in self._known:
            raise ValueError(f"extractor {extractor.name} is there already")
        self._known[extractor.name] = extractor
        return self

    def names(self) -> list[str]:
        return list(self._known)

    def run(self, files: DataFrame) -> dict[str, DataFrame]:
        """Each output's rows (path, extractor, ...) from files (path, lang, content). Null content counts as empty, a
        language that no extractor reads has no rows. An extractor that fails on a file costs that file a warning row
        of its own, and no other its rows."""
        extractors, outputs = list(self._known.values()), set(self.outputs)

        def one(extractor: Extractor, path: str, content: str) -> Iterator[tuple]:
            try:
                found = list(extractor.rows(path, content))
                if unknown := {o for o, _ in found} - outputs:
                    raise ValueError(f"unknown outputs {sorted(unknown)}")
            except Exception as e:
                found = [("warnings", {"warning": f"{extractor.name}: {path}: {e}"})]
            for output, row in found:
                yield path, extractor.name, output, json.dumps(row)

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame([r for p, lang, c in zip(f.path, f.lang, f.content) for x in extractors if lang in x.langs for r in one(x, p, c or "")], columns=["path", "extractor", "output", "row"])

        langs = sorted({lang for x in extractors for lang in x.langs})
        raw = cut(files.where(F.col("lang").isin(langs)).select("path", "lang", "content").mapInPandas(work, RAW))
        read = lambda name: raw.where(F.col("output") == name).select("path", "extractor", F.from_json("row", self.outputs[name]).alias("r")).select("path", "extractor", "r.*")
        return {name: read(name) for name in self.outputs}
