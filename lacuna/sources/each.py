"""A sink of one indented JSON file a row, written by the tasks themselves.

The folder must be one that all executors share under the same path. A task writes below a folder of its own attempt;
only when all tasks are done are their files moved to their names, which takes no content through the driver. A failed
task's files, and all files of a failed job, are removed, so readers never see a part of a set beside an older one's
leftovers.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "lacuna_json_files"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class JsonFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, names = os.path.join(self.path, self.run, uuid.uuid4().hex), []
        os.makedirs(folder)
        for name, text in iterator:
            if os.path.basename(name) != name or name.startswith("_"):
                raise ValueError(f"{name!r} can't be a file's name here")
            with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as f:
                json.dump(json.loads(text), f, indent=2, ensure_ascii=False)
            names.append(f"{name}.json")
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        count = 0
        for done in filter(None, messages):
            for name in done.names:
                os.replace(os.path.join(done.folder, name), os.path.join(self.path, name))
            count += len(done.names)
        self._clear()
        with open(os.path.join(self.path, "_SUCCESS"), "w") as f:
            f.write(str(count))

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(os.path.join(self.path, self.run), ignore_errors=True)


class JsonFiles(DataSource):
    """Rows of (name, json) become path/name.json."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, json string"

    def writer(self, schema, overwrite: bool) -> JsonFilesWriter:
        return JsonFilesWriter(self.options["path"])
