"""Instances: named sets of tables under one root, kept in a registry file on the driver's side."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class Instances:
    """Create, switch, archive and delete instances; an instance's tables are Parquet folders below its path."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)
        self.file = self.root / "instances.json"
        self.state = json.loads(self.file.read_text()) if self.file.exists() else {"active": None, "instances": {}}

    def _save(self) -> None:
        self.root.mkdir(parents=True, exist_ok=True)
        tmp = self.file.with_suffix(".tmp")
        tmp.write_text(json.dumps(self.state, indent=1, sort_keys=True))
        tmp.replace(self.file)

    def create(self, name: str) -> str:
        """A new instance; its slug is unique by a number. The first becomes active."""
        base = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")[:60] or "instance"
        slug, k = base, 2
        while slug in self.state["instances"]:
            slug, k = f"{base}-{k}", k + 1
        self.state["instances"][slug] = {"name": name, "archived": False}
        self.state["active"] = self.state["active"] or slug
        self._save()
        return slug

    def _get(self, slug: str) -> dict:
        if slug not in self.state["instances"]:
            raise KeyError(f"no instance {slug}")
        return self.state["instances"][slug]

    def switch(self, slug: str) -> None:
        if self._get(slug)["archived"]:
            raise ValueError("an archived instance can't be active")
        self.state["active"] = slug
        self._save()

    def archive(self, slug: str) -> None:
        self._get(slug)
        if self.state["active"] == slug:
            raise ValueError("the active instance can't be archived")
        self.state["instances"][slug]["archived"] = True
        self._save()

    def unarchive(self, slug: str) -> None:
        self._get(slug)["archived"] = False
        self._save()

    def delete(self, slug: str) -> None:
        """Only archived, inactive instances; files stay for the caller to remove."""
        if not self._get(slug)["archived"] or self.state["active"] == slug:
            raise ValueError("only an archived, inactive instance can be deleted")
        del self.state["instances"][slug]
        self._save()

    def path(self, table: str, slug: str | None = None) -> str:
        slug = slug or self.state["active"]
        self._get(slug)
        return f"{self.root}/{slug}/{table}"

    def read(self, spark: SparkSession, table: str, slug: str | None = None) -> DataFrame:
        return spark.read.parquet(self.path(table, slug))
