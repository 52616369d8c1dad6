"""Where data lies: an INI file with the connection and the data folder, and the folders below it."""

from __future__ import annotations

import configparser
from dataclasses import dataclass

# Folders below the data folder, by what they hold.
FOLDERS = {
    "reports": "congress_reports",
    "bills": "bills",
    "classification": "classification_data",
    "extracts": "OMB",
    "laws": "plaws",
}


@dataclass(frozen=True)
class Configuration:
    connection: str
    data: str

    @classmethod
    def read(cls, path: str, section: str = "keys") -> Configuration:
        """From a section with ``conn`` and ``data``; a missing one is an error."""
        parser = configparser.ConfigParser(interpolation=None)
        with open(path, encoding="utf-8") as f:
            parser.read_file(f)
        return cls(parser.get(section, "conn"), parser.get(section, "data"))

    def folder(self, kind: str) -> str:
        """The folder of one kind of data; the data folder may be of any file system that Spark reads."""
        return f"{self.data.rstrip('/')}/{FOLDERS[kind]}"
